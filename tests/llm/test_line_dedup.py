from claimspark.llm.line_dedup import LineRuns, line_dedup
from tests.llm.data import awkward, documents, prose

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def expected(texts, least=10):
    place = lambda i: 2**63 - 1 if i is None else i
    owner = {}
    for i, t, _ in texts:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), place(i)), place(i))
    out = []
    for i, t, _ in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == place(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    texts = awkward() + [(100 + i, "\n".join(prose(k % 13, 4 + k % 3) + ("" if k % 2 else "\r") for k in range(i, i + 9)), "a") for i in range(30)]
    texts += [(400, "É" * 10 + "\n" + "é" * 10, "a"), (401, "É" * 10 + "\n" + "x" * 9, "a"), (402, "x" * 9, "a")]
    docs = documents(spark, texts)
    for batches, fan in ((1, 2), (4, 2), (7, 3)):
        rows = line_dedup(docs, batches=batches, fan=fan).collect()
        assert sorted(((r["doc_id"], r["text"], r["line_count"], r["lines_dropped"]) for r in rows), key=str) == expected(texts)
        assert {r["norm"] for r in rows} == {"x"} and {r["ids"] for r in rows} == {"y"}


def test_levels_stay_few(spark):
    runs = LineRuns(fan=2)
    for i in range(7):
        keys = spark.createDataFrame([(k, k, i) for k in range(i, i + 5)], "h1 long, h2 long, owner long")
        runs.add(keys)
    assert len(runs.runs()) == 3  # 7 batches: runs of 4, 2 and 1
    rows = [tuple(r) for run in runs.runs() for r in run.collect()]
    assert sorted(rows) == [(k, k, max(0, k - 4)) for k in range(11)]


def test_empty_table(spark):
    assert line_dedup(documents(spark, [])).count() == 0
