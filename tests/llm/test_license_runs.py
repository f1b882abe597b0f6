"""Notices over several lines, shared ids, and runs compared with a plain version on hostile texts."""

from __future__ import annotations

import random
from collections import defaultdict

from incident_analytics.llm import license_scan as ls

MIT = dict(ls.TEMPLATES)["MIT-grant"]
APACHE = dict(ls.TEMPLATES)["Apache-2.0-notice"]


def wrapped(text: str, lead: str, per_line: int) -> str:
    words = text.split()
    return "\n".join(lead + " ".join(words[i:i + per_line]) for i in range(0, len(words), per_line))


def plain(text: str, percent: int = ls.THRESHOLD_PERCENT) -> tuple[int, str]:
    """Every run of lines against every template, one by one."""
    templates = {name: set(ls.template_bigrams(t)) for name, t in ls.TEMPLATES}
    most = max(map(len, templates.values())) * (200 - percent) // percent + 1
    lines = [w for w in map(ls.normal_words, text.split("\n")) if w]
    spans = defaultdict(list)
    for i in range(len(lines)):
        run: list[str] = []
        for j in range(i, len(lines)):
            run += lines[j]
            if len(run) > most:
                break
            grams = {f"{a} {b}" for a, b in zip(run, run[1:])}
            for name, template in templates.items():
                if 200 * len(grams & template) >= percent * (len(grams) + len(template)):
                    spans[name].append((i, j))
    n = 0
    for found in spans.values():
        reach = -1
        for i, j in sorted(found):
            n += i > reach
            reach = max(reach, j)
    return n, ",".join(sorted(spans))


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: (r.n_matches, r.licenses, r.dice) for r in ls.scan_licenses(df).collect()}


def test_wrapped_notices_are_found(spark):
    rows = [(1, "int main() {}\n" + wrapped(MIT, " * ", 7) + "\nint x;"), (2, wrapped(APACHE, "# ", 5)),
            (3, wrapped(APACHE, "\n\n// ", 1)), (4, "x\n" * 50_000 + wrapped(MIT, "-- ", 9) + "\ny" * 50_000),
            (5, "All rights\nreserved."), (6, "licensed under\ncc by\nsa 4.0")]
    got = scan(spark, rows)
    assert got[1] == (1, "MIT-grant", 1.0) and got[4][:2] == (1, "MIT-grant")
    assert got[2][1].split(",")[-1] == "Apache-2.0-notice" == got[3][1].split(",")[-1] and got[2][2] == 1.0
    assert got[5][:2] == (1, "Proprietary") and "CC-BY-SA-4.0" in got[6][1]


def test_texts_of_one_id_are_not_mixed(spark):
    bsd = dict(ls.TEMPLATES)["BSD-3-Clause"].split()
    rows = [(1, " ".join(bsd[:10] + ["word"] * 9)), (1, " ".join(["word"] * 9 + bsd[9:])),
            (2, "All rights reserved."), (2, "All rights reserved."), (2, "Top.\n\nAll rights reserved.")]
    got = scan(spark, rows)
    assert got[1][0] == 0 and got[2] == (2, "Proprietary", 1.0)


def test_runs_equal_the_plain_version(spark):
    rng = random.Random(5)
    notices = [t for _, t in ls.TEMPLATES]
    rows = []
    for i in range(150):
        words: list[str] = []
        for _ in range(rng.randint(1, 6)):
            part = rng.choice(notices).split()
            words += [w for w in part if rng.random() > 0.07] + ["filler"] * rng.choice([0, 0, 3, 90])
        text = "".join(w + rng.choice([" ", " ", " ", "\n", " \r\n\n# ", "É "]) for w in words)
        rows.append((i, text * rng.choice([1, 1, 1, 9])))
    got = scan(spark, rows)
    assert {i: got[i][:2] for i, _ in rows} == {i: plain(t) for i, t in rows}
    assert sum(n for n, _, _ in got.values()) > 100
