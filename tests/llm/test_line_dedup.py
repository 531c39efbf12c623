import pytest
from pyspark.sql import functions as F

from tallybook.llm import line_dedup

A = "a1\na2\na3\na4"
ROWS = [
    (2, "x\n" + A + "\ny"), (1, A), (3, "a2\na3\na4"), (4, "a1\na2"), (5, "\n\n\n\nq"), (6, "\n\n\n\nr"),
    (7, "k\nl\nm\nk\nl\nm\nn"), (8, None), (9, ""), (None, A + "\nz"), (10, "new\nlines\nhere"), (10, "new\nlines\nhere"),
    (11, " a1\na2\na3"), (12, "s\ns\ns\ns\ns"),
]


def brute(rows, window=3):
    """Keeps the first occurrence of each window by (id, line); the rows have no two texts of one id."""
    seen, out = {}, {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines, covered = text.split("\n"), set()
        for at in range(len(lines) - window + 1):
            key = tuple(lines[at : at + window])
            if any(x.strip(" ") for x in key) and seen.setdefault(key, (i, at)) != (i, at):
                covered.update(range(at, at + window))
        out[i, text] = ("\n".join(x for k, x in enumerate(lines) if k not in covered), len(lines), len(covered))
    return sorted((i, *out[i, text]) for i, text in rows if i is not None), [out[i, t] for i, t in rows if i is None]


def run(docs):
    found = [tuple(r) for r in line_dedup.remove_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_removed").collect()]
    return sorted((r for r in found if r[0] is not None), key=str), [r[1:] for r in found if r[0] is None]


def test_against_brute_force(spark, documents):
    with_id, without = brute([r for r in ROWS if r[1] is not None])
    assert run(documents(ROWS)) == (sorted([*with_id, (8, None, 0, 0)], key=str), without)


def test_other_columns_stay(spark, documents):
    docs = documents([(1, A), (2, A)]).withColumns({c: F.lit(1) for c in ("starts", "hash", "id", "a", "line", "n_removed")})
    found = line_dedup.remove_repeated_lines(docs)
    assert {(r["doc_id"], r["starts"], r["n_removed"]) for r in found.collect()} == {(1, 1, 0), (2, 1, 4)}
    assert "odd name" in found.columns and found.columns.count("n_removed") == 1
    again = line_dedup.remove_repeated_lines(found)
    assert again.count() == 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a\nb")]])
def test_nothing_to_do(spark, documents, rows):
    assert run(documents(rows))[0] == sorted(((i, t, 0 if t is None else 2, 0) for i, t in rows), key=str)


def test_a_line_that_many_documents_share(spark, documents):
    rows = [(i, f"p{i}\nfoot 1\nfoot 2\nfoot 3\nfoot 4\nq{i}") for i in range(300)]
    assert run(documents(rows, 4))[0] == sorted(brute(rows)[0], key=str)


def test_a_very_long_document(spark, documents):
    rows = [(1, "\n".join(str(i % 5000) for i in range(20_000))), (2, "7\n8\n9")]
    assert run(documents(rows))[0] == sorted(brute(rows)[0], key=str)
