"""Publication: closed tables as CSV and metadata as JSON, without identifiers, all or nothing."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.extracts import Study
from .analysis import Analysis, Config, run_analysis, source_rows
from .contract import check_metadata
from .figures import figures
from .schemas import SCHEMAS
from .store import MANIFEST, publish


def check_tables(tables: dict[str, pd.DataFrame]) -> None:
    """Exactly the schemas' tables, with exactly their columns in order, and none of members."""
    if list(tables) != list(SCHEMAS):
        raise ValueError("tables are missing, unknown or out of order")
    for name, t in tables.items():
        if tuple(t.columns) != SCHEMAS[name]:
            raise ValueError(f"{name}: columns are not those of its schema")
        if "member_id" in t.columns:
            raise ValueError(f"{name} has member_id")


def strings_of(value: object) -> Iterator[str]:
    """The strings of a cell or of nested metadata, keys included; of JSON text also what it decodes to."""
    if isinstance(value, str):
        yield value
        try:
            decoded = json.loads(value)
        except (ValueError, RecursionError):
            return
        if decoded != value:
            yield from strings_of(decoded)
    elif isinstance(value, Mapping):
        for k, v in value.items():
            yield from strings_of(k)
            yield from strings_of(v)
    elif isinstance(value, (list, tuple, set, frozenset)):
        for v in value:
            yield from strings_of(v)


#: Published text is a report's; more of it than this is no report, and too much to send to every task.
MOST_TEXT = 1 << 25


class Needles:
    """Tells which of many strings stand in one text, by hashes of all the text's parts of a string's length.

    The hash of a part is a polynomial in its characters, worked out for all
    parts at once; a string whose hash is there is then looked for itself.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, text: str) -> None:
        if len(text) > MOST_TEXT:
            raise ValueError("the published text is too long to be a report")
        self.text = text
        self._points = _points(text)
        self._parts: dict[int, np.ndarray] = {}

    def _hashes(self, size: int) -> np.ndarray:
        if size not in self._parts:
            if len(self._parts) > 8:
                self._parts.clear()
            h = np.zeros(max(len(self._points) - size + 1, 0), np.uint64)
            for k in range(size):
                h = h * self.BASE + self._points[k : k + len(h)]
            self._parts[size] = np.unique(h)
        return self._parts[size]

    def first_in(self, strings: Iterable[str]) -> str | None:
        by_size: dict[int, set[str]] = {}
        for s in strings:
            by_size.setdefault(len(s), set()).add(s)
        for size, group in by_size.items():
            if not 0 < size <= len(self.text):
                continue
            own = sorted(group)
            if size > 256:  # no identifier, but no reason to miss it
                found = [s for s in own if s in self.text]
            else:
                h = np.zeros(len(own), np.uint64)
                letters = _points("".join(own)).reshape(len(own), size)
                for k in range(size):
                    h = h * self.BASE + letters[:, k]
                parts = self._hashes(size)
                at = np.minimum(np.searchsorted(parts, h), len(parts) - 1)
                found = [own[k] for k in np.flatnonzero(parts[at] == h).tolist() if own[k] in self.text]
            if found:
                return found[0]
        return None


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _plain(i: str | None) -> str:
    return i.strip().casefold() if i is not None else ""


def check_privacy(values: Iterable[object], identifiers: DataFrame | Iterable[str]) -> None:
    """Fail if a text holds an identifier, whatever its form, case and the spaces around it.

    The values are the published cells and metadata, which are few; numbers
    are no texts.  Identifiers are a table of one column, or strings; blank
    ones are none.  The identifiers of a table are looked for where they are:
    the published text goes to the tasks, and one row comes back if there is
    a hit, without the identifier.
    """
    needles = Needles("\n".join(dict.fromkeys(_plain(t) for v in values for t in strings_of(v))))
    if isinstance(identifiers, DataFrame):

        def hits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in frames:
                if needles.first_in(map(_plain, f.column(0).unique().to_pylist())) is not None:
                    yield pa.RecordBatch.from_pydict({"hit": [True]})
                    return

        found = not identifiers.mapInArrow(hits, "hit boolean").limit(1).isEmpty()
    else:
        found = needles.first_in(map(_plain, identifiers)) is not None
    if found:
        raise ValueError("an identifier is in the output")


def member_ids(study: Study) -> DataFrame:
    """The identifiers of all four tables, as they stand there."""
    ids = [t.select(F.col("member_id").cast("string").alias("member_id")) for t in (study.demographics, study.weights, study.engagement, study.modules)]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).unionByName(ids[3])


def _taken_back(path: Path, kept: Path | None) -> bool:
    """Put the file before in the place of a published one; False if that fails."""
    try:
        if kept is not None:
            os.replace(kept, path)
        else:
            path.unlink(missing_ok=True)
    except OSError:
        return False
    return True


def output_files(result: Analysis, identifiers: DataFrame | Iterable[str] = ()) -> dict[str, str]:
    """The checked tables, figures and metadata as texts by file name."""
    check_tables(result.tables)
    files = {f"{n}.csv": t.to_csv(index=False, lineterminator="\n", float_format="%.12g") for n, t in result.tables.items()}
    if set(SCHEMAS) <= set(result.tables):
        files |= {f"{n}.svg": text for n, text in figures(result.tables).items()}
    files["metadata.json"] = json.dumps(result.metadata, indent=2, sort_keys=True) + "\n"
    cells = (v for t in result.tables.values() for v in t.to_numpy(dtype=object).ravel())
    drawn = (text for n, text in files.items() if n.endswith(".svg"))
    check_privacy(chain(cells, drawn, [result.metadata]), identifiers)
    return files


def write_outputs(result: Analysis, folder: str, *, source: str | None = None, identifiers: DataFrame | Iterable[str] = ()) -> list[Path]:
    """Write all tables and the metadata; the folder gets all of them or stays as it was.

    Files are made in a folder beside it and then put in place one by one; if
    that fails, those already in place are taken back.  The output must not
    be the source folder or lie in it.
    """
    target = Path(folder).resolve()
    if source is not None and (target == Path(source).resolve() or Path(source).resolve() in target.parents):
        raise ValueError("the output would lie in the source folder")
    files = output_files(result, identifiers)
    target.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=".stage-", dir=target.parent))
    done: list[tuple[Path, Path | None]] = []
    try:
        for name, text in files.items():
            with open(stage / name, "w", encoding="utf-8", newline="") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
        for name in files:
            kept = None
            if (target / name).exists():
                kept = stage / f"{name}.before"
                os.replace(target / name, kept)
            done.append((target / name, kept))
            os.replace(stage / name, target / name)
    except BaseException:
        # a file that can't be taken back stays in the stage folder, which is then kept
        lost = [path.name for path, kept in reversed(done) if not _taken_back(path, kept)]
        if lost:
            raise RuntimeError(f"not restored: {', '.join(lost)}; the files before are in {stage}") from sys.exception()
        shutil.rmtree(stage, ignore_errors=True)
        raise
    shutil.rmtree(stage, ignore_errors=True)
    return [target / name for name in files]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Analyse a folder of member extracts.")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--seed", type=int, default=Config.seed)
    p.add_argument("--cv-folds", type=int, default=Config.cv_folds)
    p.add_argument("--cv-repeats", type=int, default=Config.cv_repeats)
    p.add_argument("--stability-resamples", type=int, default=Config.resamples)
    a = p.parse_args(argv)
    config = Config(seed=a.seed, cv_folds=a.cv_folds, cv_repeats=a.cv_repeats, resamples=a.stability_resamples)
    from pyspark.sql import SparkSession

    from ..sources.extracts import load_study

    spark = SparkSession.builder.appName("cohort").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    study = load_study(spark, a.data_dir)
    result = run_analysis(study, config=config)
    # against the sources as they are now, read again
    check_metadata(result.metadata, result.tables, source_rows(load_study(spark, a.data_dir)))
    if "://" in a.output_dir:  # a shared store
        if a.output_dir.rstrip("/") == a.data_dir.rstrip("/") or a.output_dir.startswith(a.data_dir.rstrip("/") + "/"):
            raise ValueError("the output would lie in the source folder")
        publish(spark, output_files(result, member_ids(study)), a.output_dir)
        print(f"{a.output_dir}/{MANIFEST}")
        return
    for path in write_outputs(result, a.output_dir, source=a.data_dir, identifiers=member_ids(study)):
        print(path)


if __name__ == "__main__":
    main()
