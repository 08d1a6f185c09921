"""A generated study, written as the source extracts are: UTF-16, tab-separated, a trailing empty column."""

from __future__ import annotations

import random
from datetime import date, timedelta
from pathlib import Path

TREATED, REFERENCE = "Active GLP-1 for Weight-loss", "Coaching Only"


def spelled(d: date, k: int) -> str:
    return f"{d.day} {d.strftime('%B %Y')}" if k % 2 else f"{d.strftime('%B')} {d.day}, {d.year}"


def write_study(folder: Path, n: int = 64, seed: int = 3) -> None:
    rng = random.Random(seed)
    start = date(2025, 1, 1)
    files = {"Data Analyst Case Study Doc 1 - 12 Weeks Weight Loss Modules Completion.csv": [["Readable Id", "Questionnaire Title (All Questionnaire Records)", "Day of Answered At (All Questionnaire Records)"]], "Data Analyst Case Study Doc 2 - Demographics.csv": [["Readable Id", "Day of Start Date", "Status (Subscriptions)", "cancellation_date", "Sex", "ethnicity"]], "Data Analyst Case Study Doc 3 - Engagement Data.csv": [["Readable Id", "Day of Activity Timestamp", "Type"]], "Data Analyst Case Study Doc 4 - BW_Detail.csv": [["User Id", "Weight-loss Member Type", "Day of BW First Measurement Effective", "Day of BW Last Measurement Effective", "First", "Last", "Diff", "BW Days between First/Last", "days in weight-loss program"]]}
    modules, people, events, weights = files.values()
    for k in range(n):
        name, kind = f"member-{k:03d}", (TREATED, REFERENCE)[k % 2]
        status = " paused" if k == 4 else " finished " if k % 3 else "ACTIVE"
        people.append([name, spelled(start, k), status, "NULL", ("FEMALE", "MALE")[k // 2 % 2] if k != 9 else "", ("A", "B", "  ")[k % 3]])
        if k == 6:
            continue  # no weight row
        days = 0 if k == 8 else 60 + 3 * (k % 20)
        first = 150.0 + 2 * k
        loss = -20 + 0.15 * first + 3 * (k % 2 == 0) + rng.gauss(0, 0.8)
        last = first * (1 - loss / 100)
        weights.append([name, "Null" if k == 10 else kind, spelled(start, k), spelled(start + timedelta(days), k + 1), f"{first:.3f}" if k != 12 else "", f"{last:.3f}", "", str(days), str(days + 5)])
        for e in range(1 + rng.randrange(12)):
            events.append([name, spelled(start + timedelta(rng.randrange(40)), e), ("WEIGHT", "MEAL", "LOGIN")[e % 3]])
        events.append([name, spelled(start + timedelta(400), k), "MEAL"])
        for t in range(rng.randrange(7)):
            modules.append([name, ("01_Intro", "05_Food", "MINDSET W01: a", "NUTRITION W02: b", "PHYSICAL ACTIVITY W03: c", "03_Other", "MINDSET W05: z")[t], spelled(start + timedelta(3 * t), t)])
    weights.append(["orphan", TREATED, *weights[1][2:]])
    folder.mkdir(parents=True, exist_ok=True)
    for filename, rows in files.items():
        text = "\n".join("\t".join([*r, ""]) for r in rows) + "\n"
        (folder / filename).write_text(text, encoding="utf-16")
