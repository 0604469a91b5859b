"""The whole pipeline against a plain version of it, on documents and odd rows."""

from collections import Counter

import pytest
from test_llm import SCHEMA, WORDS, alnum, brute_components, brute_lines, corpus, covered, reference_encoding


def brute_kept(t):
    t = t or ""
    w = WORDS.findall(t)
    n = len(w)
    seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    repeated = len(covered([i for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1], 8, n))
    filled = [x for x in t.split("\n") if WORDS.search(x)]
    dup, chars = len(filled) - len(set(filled)), sum(map(len, w))
    letters = [c for c in t if c.isascii() and c.isalpha()]
    return not (
        n < 20 or 100 * repeated > 30 * n or 5 * sum(t.count(c) for c in "#*$%&|<>") > n or (2 * dup > len(filled) and dup >= 4)
        or 2 * sum(a == b for a, b in zip(w, w[1:])) > n or chars < 2 * n or chars > 20 * n or 2 * sum(map(str.isupper, letters)) > len(letters)
    )


def brute_pipeline(rows, items):
    rows = [r for r in rows if brute_kept(r[1])]
    cut = [(d, t) for d, t, n, gone in brute_lines(rows, 3, 35) if not gone or gone < n]
    firsts = sorted(dict.fromkeys(cut), key=repr)
    least = {c for _, n, c in brute_components(firsts, 5, 80, 100) if n} | {d for d, n, _ in brute_components(firsts, 5, 80, 100) if not n}
    kept = [(d, t) for d, t in firsts if d in least]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(alnum, items) if w for i in range(len(w) - min(10, len(w)) + 1)}

    def clean(t):
        w = alnum(t)
        return not any(tuple(w[i : i + n]) in windows for n in {len(g) for g in windows} for i in range(len(w) - n + 1))

    return sorted(((d, t) for d, t in kept if clean(t)), key=repr)


@pytest.mark.parametrize("with_documents", [False, True])
def test_pipeline_brute_force(spark, sf_dir, tmp_path, with_documents):
    import corpus_pipeline as cp
    import public_tokenizers
    from pactlake.llm import bpe

    rows = [r[:2] for r in corpus()]
    rows = [(None if d is None else d + 10**6, t) for d, t in rows if d is not None]  # equal ids of unequal texts are no part of this test
    if with_documents:
        rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    folder = tmp_path / "in"
    wide = [(d, t, *(None,) * 12) for d, t in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    got = cp.run(spark, str(folder)).collect()
    want = brute_pipeline(rows, items)
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, _ in want), key=repr)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lib = reference_encoding(bpe.Ranks.read(f.read().splitlines()))
    said = {(d, tuple(lib.encode_ordinary(t or ""))) for d, t in want}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == said and all(r.decodes for r in got)


def test_line_dedup_passages(spark, sf_dir):
    """Passages of 50 words that repeat on one or on two whole lines go."""
    import corpus_pipeline as cp

    said = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    one, two = said("p", 50), said("q", 25) + "\n" + said("r", 25)
    rows = [(1, one + "\nown a"), (2, "own b\n" + one), (3, two + "\nown c"), (4, "own d\n" + two), (5, said("q", 25))]
    out = cp.line_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf_dir)
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "own b", 3: rows[2][1], 4: "own d", 5: rows[4][1]}
