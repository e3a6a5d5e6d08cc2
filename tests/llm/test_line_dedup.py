import hashlib
import random
import re

from llm_support import SF
from test_toxicity import levenshtein

from cartwheel.llm import line_dedup as D, queries


def brute(rows, min_length=16):
    """{(doc_id, line_no, line)} that stay."""
    first = {}
    for doc_id, text in rows:
        for n, raw in enumerate((text or "").split("\n")):
            line = re.sub(r"[ \t\n\x0b\f\r]+", " ", raw).strip(" ").lower()
            at = (doc_id is None, doc_id or 0, n)
            if line and (line not in first or at < first[line][0]):
                first[line] = (at, doc_id, n)
    kept = set()
    for line, (at, doc_id, n) in first.items():
        near = (o for o, (b, _, _) in first.items() if b < at and len(o) >= min_length and len(line) >= min_length and abs(len(o) - len(line)) <= 1)
        if not any(levenshtein(o, line) <= 1 for o in near):
            kept.add((doc_id, n, line))
    return kept


def check(docs, rows, **kw):
    assert {tuple(r) for r in D.line_dedup(docs, **kw).collect()} == brute(rows, **kw)


def edited(rnd, line):
    i = rnd.randrange(len(line))
    return rnd.choice([line[:i] + line[i + 1 :], line[:i] + "q" + line[i + 1 :], line[:i] + "z" + line[i:]])


def test_every_edit_is_found_and_nothing_else(spark):
    rnd = random.Random(4)
    alphabet = "abcdeé fgh"
    lines = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14, 40))) for _ in range(40)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rnd.randrange(1, 4)):
            line = rnd.choice(lines)
            for _ in range(rnd.randrange(0, 3)):
                line = edited(rnd, line)
            text.append(line)
        rows.append((i, "\n".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_repeated_letters_and_ends(spark):
    base = "aaaaaaaaaaaaaaaaaaaaaa"
    rows = [(1, base), (2, base + "a"), (3, base + "aa"), (4, "b" + base), (5, base + "b"), (6, "b" + base[1:]), (7, "short"), (8, "shorter"), (9, "short")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_awkward(awkward, no_docs):
    docs = awkward.filter("doc_id is null or doc_id <> 8")  # the long text is one line; its edits are tested below
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(docs, rows)
    assert D.line_dedup(no_docs).count() == 0
    assert D.per_document(no_docs, D.line_dedup(no_docs)).count() == 0


def test_very_long_lines(spark):
    line = " ".join(f"word{i}" for i in range(4000))
    rows = [(1, line), (2, line[:9000] + "#" + line[9000:]), (3, line[:200] + "#" + line[201:])]
    kept = D.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [1]


def test_per_document(awkward):
    kept = D.line_dedup(awkward)
    got = {r.doc_id: r for r in D.per_document(awkward, kept).collect()}
    lines = [tuple(r) for r in kept.collect()]
    for doc_id, r in got.items():
        mine = [(n, line) for d, n, line in lines if d == doc_id]
        assert r.n_kept == len(mine)
        assert r.kept_digest == sum(int(hashlib.md5(f"{n}:{line}".encode()).hexdigest()[:8], 16) for n, line in mine)
    assert got[2].n_lines == 2 and got[6].n_lines == 0


def test_one_hot_line_with_many_variants(spark):
    """Thousands of lines one substitution away from each other: links stay linear."""
    rows = [(i, f"the very same line of text number {chr(0x4E00 + i)} again and again") for i in range(2000)]
    kept = D.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [r.doc_id for r in kept] == [0]


def test_query_against_sql(spark, duck_check):
    from compare import compare

    assert compare(queries.queries()["op1_line_dedup"](spark, SF), duck_check, queries.OP1_SQL) is None


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = D.per_document(docs, D.line_dedup(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
