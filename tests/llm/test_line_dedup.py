"""Line dedup against its SQL, against brute force over odd lines, and the cases of its docstring."""

from __future__ import annotations

import random
import re

from wirespan.llm import line_dedup
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, key string, at int, n_lines int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def brute(rows):
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        left = []
        for raw in (text or "").split("\n"):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ")
            if not line or not any(line == s or (min(len(line), len(s)) >= 20 and within_one(line, s)) for s in seen):
                left.append(raw)
            seen.append(line)
        out[doc_id] = "\n".join(left) if left else None
    return out


def test_table_against_sql(spark):
    assert assert_same(line_dedup.op2_line_dedup(spark, SF), line_dedup.ORACLE_SQL, SF) > 0


def test_edits_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé 世", k=rng.randint(18, 30))).strip() + "x" for _ in range(8)]

    def edited(line):
        at = rng.randrange(len(line))
        return rng.choice([line, line[:at] + "q" + line[at:], line[:at] + line[at + 1 :], line[:at] + "q" + line[at + 1 :], line[:at] + "qq" + line[at + 2 :]])

    rows = [(i, "\n".join([edited(rng.choice(base)) for _ in range(3)] + [f"short {i % 40}", "", " "])) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    line = "a line that is long enough"
    rows = [(1, None), (2, ""), (3, line), (4, f"{line}\nfresh and new and long enough"), (5, line.replace("that", "thus")), (6, line[:-1]), (None, "no id but some long text here"), (7, "x" * 60_000), (8, "x" * 59_999), (9, line), (9, line)]
    out = line_dedup.dedup_lines(frame(spark, rows))
    got = [(r.doc_id, r.text, r.n_lines, r.n_copies, r.n_near) for r in out.collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3, 4)) == [(1, None, 1, 0, 0), (2, "", 1, 0, 0), (3, line, 1, 0, 0), (4, "fresh and new and long enough", 2, 1, 0)]
    assert [x for x in got if x[0] == 6] == [(6, None, 1, 0, 1)]
    assert [x for x in got if x[0] == 5][0][1] is not None  # two edits away
    assert [x for x in got if x[0] == 8] == [(8, None, 1, 0, 1)]
    assert [x for x in got if x[0] == 9] == [(9, None, 1, 1, 0)] * 2
    left = line_dedup.without_repeated_lines(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "key", "at", "n_lines"]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, 1, 2, 3, 4, 5, 7]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []
