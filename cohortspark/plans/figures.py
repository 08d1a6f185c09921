"""The published figures, drawn as SVG from the published tables alone, without a plotting library.

Each panel is one series on one axis: a labelled row a value, with its
interval if it has one, or points in a plane.  Labels carry identity, so one
hue does; each mark's numbers are its tooltip.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from html import escape

import pandas as pd

FIGURES = (
    "cohort_flow", "weight_loss_by_member_type", "responder_rate_by_member_type", "engagement_patterns", "module_completion",
    "base_model_performance", "lasso_stability", "locked_model_coefficients", "model_diagnostics"
)

WIDTH, LABEL, ROW, PLOT = 860, 320, 24, 220
SURFACE, INK, MUTED, GRID, MARK = "#ffffff", "#1f2328", "#59636e", "#d9dee3", "#2563a8"


@dataclass(frozen=True)
class Rows:
    """Labelled values, each with an interval or without; ``limit`` is a line across all of them."""

    title: str
    rows: Sequence[tuple[str, float, float | None, float | None]]
    bars: bool = False
    limit: float | None = None


@dataclass(frozen=True)
class Points:
    title: str
    points: Sequence[tuple[float, float]]
    x: str
    y: str


def _known(values: Iterable[float | None]) -> list[float]:
    return [float(v) for v in values if v is not None and not pd.isna(v) and math.isfinite(v)]


def _ends(values: Sequence[float], zero: bool) -> tuple[float, float]:
    own = [*values, 0.0] if zero or not values else list(values)
    lo, hi = min(own), max(own)
    return (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)


def _text(x: float, y: float, s: str, *, size: int = 12, fill: str = INK, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" fill="{fill}" text-anchor="{anchor}">{escape(s)}</text>'


def _rows(panel: Rows, top: float) -> tuple[list[str], float]:
    shown = [(label, v, lo, hi) for label, v, lo, hi in panel.rows if _known([v])]
    lo, hi = _ends(_known([x for r in shown for x in r[1:]] + [panel.limit]), panel.bars)
    place = lambda v: LABEL + (v - lo) / (hi - lo) * (WIDTH - LABEL - 90)
    bottom = top + ROW * len(shown)
    out = [_text(12, top - 8, panel.title, size=13)]
    for t in (lo, hi):
        out += [
            f'<line x1="{place(t):.1f}" y1="{top}" x2="{place(t):.1f}" y2="{bottom}" stroke="{GRID}"/>',
            _text(place(t), bottom + 14, f"{t:.3g}", size=11, fill=MUTED, anchor="middle")
        ]
    if panel.limit is not None:
        out.append(f'<line x1="{place(panel.limit):.1f}" y1="{top}" x2="{place(panel.limit):.1f}" y2="{bottom}" stroke="{MUTED}" stroke-dasharray="4 3"/>')
    for k, (label, v, a, b) in enumerate(shown):
        y = top + ROW * (k + 0.5)
        told = f"{label}: {v:.4g}" + (f" ({a:.4g} to {b:.4g})" if _known([a, b]) == [a, b] else "")
        out += [_text(LABEL - 12, y + 4, label, anchor="end"), f"<g><title>{escape(told)}</title>"]
        if panel.bars:
            left, right = sorted((place(max(lo, 0.0)), place(v)))
            out.append(f'<rect x="{left:.1f}" y="{y - 7:.1f}" width="{max(right - left, 1):.1f}" height="14" rx="3" fill="{MARK}"/>')
        else:
            if _known([a, b]) == [a, b]:
                out.append(f'<line x1="{place(a):.1f}" y1="{y:.1f}" x2="{place(b):.1f}" y2="{y:.1f}" stroke="{MARK}" stroke-width="2"/>')
            out.append(f'<circle cx="{place(v):.1f}" cy="{y:.1f}" r="4.5" fill="{MARK}" stroke="{SURFACE}" stroke-width="2"/>')
        out += ["</g>", _text(WIDTH - 12, y + 4, f"{v:.4g}", fill=MUTED, anchor="end")]
    return out, bottom + 30


def _points(panel: Points, top: float) -> tuple[list[str], float]:
    own = [(x, y) for x, y in panel.points if len(_known([x, y])) == 2]
    (x0, x1), (y0, y1) = _ends([x for x, _ in own], False), _ends([y for _, y in own], False)
    at = lambda x, y: (LABEL + (x - x0) / (x1 - x0) * (WIDTH - LABEL - 90), top + PLOT - (y - y0) / (y1 - y0) * PLOT)
    out = [_text(12, top - 8, panel.title, size=13), f'<rect x="{LABEL}" y="{top}" width="{WIDTH - LABEL - 90}" height="{PLOT}" fill="none" stroke="{GRID}"/>']
    out += [
        _text(LABEL - 10, top + 10, f"{y1:.3g}", size=11, fill=MUTED, anchor="end"),
        _text(LABEL - 10, top + PLOT, f"{y0:.3g}", size=11, fill=MUTED, anchor="end"),
        _text(LABEL - 60, top + PLOT / 2, panel.y, size=11, fill=MUTED, anchor="end")
    ]
    out += [
        _text(LABEL, top + PLOT + 16, f"{x0:.3g}", size=11, fill=MUTED),
        _text(WIDTH - 90, top + PLOT + 16, f"{x1:.3g}", size=11, fill=MUTED, anchor="end"),
        _text((LABEL + WIDTH - 90) / 2, top + PLOT + 16, panel.x, size=11, fill=MUTED, anchor="middle")
    ]
    for x, y in own:
        a, b = at(x, y)
        out.append(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="4.5" fill="{MARK}" stroke="{SURFACE}" stroke-width="2"><title>{x:.4g}, {y:.4g}</title></circle>')
    return out, top + PLOT + 32


def draw(title: str, panels: Sequence[Rows | Points]) -> str:
    """An SVG document, the same for the same values."""
    body, at = [_text(12, 24, title, size=16)], 64.0
    for p in panels:
        lines, end = _rows(p, at) if isinstance(p, Rows) else _points(p, at)
        body += lines
        at = end + 28
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {at:.0f}" width="{WIDTH}" height="{at:.0f}" font-family="sans-serif" role="img" aria-label="{escape(title)}"><rect width="100%" height="100%" fill="{SURFACE}"/>'
    return "\n".join([head, *body, "</svg>"]) + "\n"


def _of(df: pd.DataFrame, label: str, value: str, lo: str | None = None, hi: str | None = None) -> list[tuple]:
    return [(str(r[label]), r[value], r[lo] if lo else None, r[hi] if hi else None) for _, r in df.iterrows()]


def figures(tables: dict[str, pd.DataFrame]) -> dict[str, str]:
    """SVG text by file stem."""
    flow, o, e, m = (tables[t] for t in ("cohort_flow", "outcomes_by_member_type", "engagement_by_member_type", "modules_by_member_type"))
    base, k, d = tables["base_model_comparison_summary"], tables["locked_model_coefficients_hc3"], tables["model_diagnostics"]
    lasso = pd.concat([tables["lasso_mean_selection"], tables["lasso_domain_selection"]])
    by = lambda df, c: [(name, own) for name, own in df.groupby(c, sort=False)]
    plots = d[d["row_type"] == "plot_summary"]
    return {
        "cohort_flow": draw("Members kept after each stage", [Rows("members", _of(flow, "stage_label", "retained_n"), bars=True)]),
        "weight_loss_by_member_type": draw(
            "Percentage loss: median and quartiles",
            [Rows("percent of first weight", _of(o[o["outcome"] == "percentage_loss"], "scope", "median", "q1", "q3"))]
        ),
        "responder_rate_by_member_type": draw(
            "Members who reached the loss threshold, with 95 % intervals",
            [Rows("percent of members", _of(o[o["outcome_type"] == "binary"], "scope", "percentage", "ci_lower", "ci_upper"))]
        ),
        "engagement_patterns": draw("Engagement: median and quartiles", [Rows(str(n), _of(own, "scope", "median", "q1", "q3")) for n, own in by(e, "metric_label")]),
        "module_completion": draw(
            "Members with a completed module",
            [Rows(str(n), _of(own, "scope", "member_completion_percentage"), bars=True) for n, own in by(m, "module_label")]
        ),
        "base_model_performance": draw(
            "Errors over the folds: mean and range",
            [Rows(str(n), _of(own, "model_id", "mean_score", "minimum_score", "maximum_score")) for n, own in by(base, "metric")]
        ),
        "lasso_stability": draw(
            "How often a term was selected",
            [Rows(str(n), _of(own, "candidate_label", "selection_frequency"), limit=float(own["selection_threshold"].iloc[0])) for n, own in by(lasso, "module_spec")]
        ),
        "locked_model_coefficients": draw(
            "Coefficients with 95 % intervals",
            [
                Rows(f"{n}: {t}", _of(row.to_frame().T, "term_label", "estimate", "ci_lower", "ci_upper")) for n,
                own in by(k, "model_id") for t, row in own.set_index("term", drop=False).iterrows() if t != "intercept"
            ]
        ),
        "model_diagnostics": draw(
            "Diagnostics by bins",
            [
                Points(f"{n[0]}: {n[1]}".replace("_", " "), list(zip(own["x_value"], own["y_value"])), "x", str(own["metric"].iloc[0]).replace("_", " ")) for n,
                own in by(plots, ["model_id", "diagnostic_type"])
            ]
        ),
    }
