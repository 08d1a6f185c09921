"""Reading UTF-16 text in byte ranges, against a reader of whole files."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from cohortspark.sources.utf16 import read_records, read_table


def by_force(text: str) -> list[list[str]]:
    """Records of tab-separated text, character by character."""
    out, record, field, state, i = [], [], "", "start", 0
    while i < len(text):
        c = text[i]
        if state == "quoted":
            if c != '"':
                field += c
            elif text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            else:
                state = "closed"
        elif c == "\t":
            record.append(field)
            field, state = "", "start"
        elif c == "\n":
            out.append([*record, field])
            record, field, state = [], "", "start"
        elif c == '"' and state == "start":
            state = "quoted"
        elif text[i : i + 2] != "\r\n":
            field, state = field + c, "plain"
        i += 1
    return out


def made(seed: int) -> str:
    rng = random.Random(seed)

    def cell() -> str:
        kind = rng.random()
        if kind < 0.15:
            return '"' + "".join(rng.choice(["a", "\n", "\t", '""', "é", "b\n"]) for _ in range(rng.randint(0, 6))) + '"'
        if kind < 0.25:
            return rng.choice(['a"b', "", "\U0001f600 z"])
        if kind < 0.4:  # two characters that hold the bytes of a line feed between them
            return "x" + chr(0x0A00 + rng.randrange(1, 256)) + chr(256 * rng.randint(1, 9)) + chr(256 * rng.randint(1, 9) + 10) + "y"
        return "".join(rng.choice("abc dé") for _ in range(rng.randint(1, 9)))

    return "h1\th2\t h3 \n" + "".join("\t".join(cell() for _ in range(3)) + rng.choice(["\n", "\r\n"]) for _ in range(30))


@pytest.mark.parametrize(("seed", "codec", "mark"), [(1, "utf-16-le", b"\xff\xfe"), (2, "utf-16-be", b"\xfe\xff"), (3, "utf-16-le", b"")])
def test_ranges_make_the_same_records(spark, tmp_path, seed, codec, mark):
    text, path = made(seed), tmp_path / "t.csv"
    path.write_bytes(mark + text.encode(codec))
    wanted = Counter(tuple(x or None for x in r) for r in by_force(text)[1:] if "\t".join(r).strip(" "))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[1], "0")
        for size in ("150", "1000000"):
            spark.conf.set(names[0], size)
            df = read_table(spark, str(path))
            assert df.columns == ["h1", "h2", " h3 "]
            assert Counter(tuple(x or None for x in r) for r in df.collect()) == wanted, size
            if size == "150":
                assert read_records(spark, str(path)).rdd.getNumPartitions() > 8
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_small_files(spark, tmp_path):
    (tmp_path / "a").write_text("a\tb\n1\t2", encoding="utf-16")
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "a")).collect()] == [("1", "2")]
    (tmp_path / "b").write_text("a\tb\n", encoding="utf-16")
    assert read_table(spark, str(tmp_path / "b")).count() == 0
    (tmp_path / "c").write_bytes(b"")
    with pytest.raises(ValueError, match="empty"):
        read_table(spark, str(tmp_path / "c"))
