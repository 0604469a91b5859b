"""The operators against brute force, on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactlake.llm import bpe, decontaminate, jaccard, langid, lines, lmscore, quality, sharding, substrings, textkit, warc
from pactlake.llm.storage import new_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid int, maybe string, kept int, id string, cut int, n_words int, label int, size int, row int"


def corpus():
    rnd = random.Random(5)
    vocab = ["ab", "cde", "é", "ñandú", "the", "of", "x1", "Straße", "ZZ", "end."]
    sentence = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randint(0, 99)) for _ in range(n))
    base, passage = sentence(120), sentence(40)
    texts = [None, "", " \n\t ", "one", "two words", base, base, base.replace("9", "8", 1), passage + " " + sentence(30), sentence(60) + "\n" + passage]
    texts += [sentence(rnd.randint(1, 80)) for _ in range(12)]
    block = "\n".join(sentence(6) for _ in range(4))
    texts += [f"head {i}\n\n{block}\n tail{i}" for i in range(3)] + [f"{block}\n{block}"]
    texts += [" ".join(["rep"] * 50), sentence(3000), "naïve\x00null " * 9, "l" * 70_000]
    rows = [(i, t, "en" if i % 2 else None, "s", i, 1, "m", 2, "i", 3, 4, 5, 6, 7) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a row twice
    rows.append((None, base, *rows[5][2:]))
    rows.append((None, None, *rows[5][2:]))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df, *cols):
    return sorted(((tuple(r)) for r in df.select(*cols).collect()), key=repr)


def covered(starts, size, n):
    return {s + j for s in starts for j in range(size) if s + j < n}


def test_words_and_hashes():
    column = pa.array(["a  bb", None, "", "bb a", "é\x0bbb", "w" * 300_000 + " bb"])
    found = []
    for texts in textkit.slices(column, limit=8):
        words = textkit.Words(texts, textkit.NON_SPACE)
        h = words.hashes()
        found += [(texts.raw(i).decode().split(), len(set(h[words.bounds[i] : words.bounds[i + 1]]))) for i in range(len(texts))]
    assert [x for x, _ in found] == [["a", "bb"], [], [], ["bb", "a"], ["é", "bb"], ["w" * 300_000, "bb"]]
    one = next(textkit.slices(pa.array(["a b", "b a b"])))
    h = textkit.Words(one, textkit.NON_SPACE).hashes()
    assert h[0] == h[3] and h[1] == h[2] == h[4] and h[0] != h[1]


def test_sharding(spark, docs, empty):
    rows = sharding.shard_documents(docs, shards=5).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(5))
    assert sharding.shard_documents(empty, shards=5).count() == 0


def test_sharding_sizes_and_hot_text(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = sharding.shard_documents(df, shards=7, carry=("text",))
    sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 2 * (0.02 * sum(sizes) / 7 + 30)
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3000


@pytest.mark.parametrize(("n", "groups", "shards"), [(20_000, 4_000, 40), (6_000, 600, 7), (3_000, 30, 9)])
def test_sharding_keeps_groups_whole(spark, n, groups, shards):
    """Sizes of shards are equal but for a group that stays whole, and a group is in one shard if some shard has room for it."""
    rnd = random.Random(n)
    rows = [(i if i % 50 else None, f"text {rnd.randrange(groups)} " * rnd.choice([1, 2])) for i in range(n)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "size bigint, shard string"), shards, text="shard", id="size", carry=("shard",)).toPandas()
    out.columns = ["id", "text", "size", "crc", "shard", "slot"]
    sizes = out.groupby("shard")["size"].sum()
    share = out["size"].sum() / shards
    assert len(out) == n and len(sizes) == shards
    small = max(0.01 * share, out.groupby("text")["size"].sum()[lambda g: g < 0.01 * share].max() if groups > 100 else 0) + out["size"].max()
    assert max(abs(sizes - share)) <= small + 1
    in_shards = out.groupby("text")["shard"].nunique()
    room = share - sizes.min()
    for text in in_shards.index[in_shards > 1]:  # only groups too large for the room that others left
        assert out[out["text"] == text]["size"].sum() > max(0.01 * share, room)
    if groups > 100:
        assert (in_shards == 1).all()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_sharding_one_text_and_id(spark):
    """Rows that are all equal, a third of all with a null id, are dealt like others."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).alias("doc_id"), F.lit("hot").alias("text"))
    sizes = [r["count"] for r in sharding.shard_documents(df, shards=8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2


def brute_substrings(rows, window):
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = covered([i for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1], window, len(w))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [4, 7, 35])
def test_substrings(docs, window):
    want = brute_substrings([r[:2] for r in corpus()], window)
    assert sorted_rows(substrings.dedup_substrings(docs, window), "doc_id", "n_words", "n_removed", "kept") == want


def test_substrings_empty(empty):
    assert substrings.dedup_substrings(empty).count() == 0


def alnum(t):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


@pytest.mark.parametrize("block_bytes", [32 << 20, 300])
def test_decontamination(spark, docs, empty, block_bytes):
    rows = corpus()
    items = [(1, rows[8][1]), (2, " ".join(rows[5][1].split()[50:62])), (3, "ZZ " + rows[15][1].split()[0]), (30, rows[15][1].split()[0]), (4, None), (5, ""), (None, rows[9][1]), (2, " ".join(rows[5][1].split()[50:62])), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        n = min(len(w), 10)
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
    want = []
    for r in rows:
        w, hit, found = alnum(r[1]), set(), set()
        for g, ids in windows.items():
            at = [i for i in range(len(w) - len(g) + 1) if tuple(w[i : i + len(g)]) == g]
            hit |= covered(at, len(g), len(w))
            found |= {str(i) for i in ids if i is not None} if at else set()
        want.append((r[0], len(w), len(hit), sorted(found)))
    got = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes)
    assert sorted_rows(got, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.without_hits("A b c d", [(1, 3)]) == "A  d"


def test_quality(docs, empty):
    ordered = quality.plan_cascade(docs)
    assert {r.name for r in ordered} == {r.name for r in quality.RULES}
    a = sorted_rows(quality.apply_cascade(docs, ordered), "doc_id", "n_words", "word_chars", "n_repeat_words", "n_dup_lines", "n_symbols", "kept")
    b = sorted_rows(quality.apply_cascade(docs, ordered[::-1], base=False), "doc_id", "kept")
    assert sorted([(x[0], x[-1]) for x in a], key=repr) == b
    want = []
    for r in corpus():
        t = r[1] or ""
        w = WORDS.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = covered([i for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1], 8, len(w))
        ls = [x for x in t.split("\n") if WORDS.search(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(rep), len(ls) - len(set(ls)), sum(t.count(c) for c in "#*$%&|<>")))
    assert sorted([x[:-1] for x in a], key=repr) == sorted(want, key=repr)
    assert quality.apply_cascade(empty, quality.plan_cascade(empty)).count() == 0


def test_quality_short_circuit(docs):
    """Each rule that isn't free is given the texts alone that the rules before it let pass, with base columns or without."""
    seen = []

    def spy(rule):
        def rejects(f):
            seen.append((rule.name, len(f.texts)))
            return rule.rejects(f)

        return quality.Rule(rule.name, rejects, rule.base, rule.free)

    few, stutter, shouting = (next(r for r in quality.RULES if r.name == n) for n in ("few_words", "stutter", "shouting"))
    one = next(textkit.slices(pa.array(["a few words"] * 9 + [" ".join(f"w{i}" for i in range(30))])))
    for base in (None, quality.Features(one)):
        seen.clear()
        assert quality.cascade(one, [spy(few), spy(stutter), spy(shouting)], base).tolist() == [0] * 9 + [-1]
        assert seen == [("few_words", 10), ("stutter", 1), ("shouting", 1)]


def brute_lines(rows, run, words=None):
    texts = {(d, t) for d, t in rows if t is not None}
    filled = {k: [i for i, x in enumerate(k[1].split("\n")) if WORDS.search(x)] for k in texts}
    first = {}
    place = lambda k, p: (k[0] is not None, k[0] or 0, p)
    wins = []
    for k in texts:
        ls = k[1].split("\n")
        for size in range(1 if words is not None else run, run + 1):
            for p in range(len(filled[k]) - size + 1):
                s = tuple(ls[i] for i in filled[k][p : p + size])
                if size == run or sum(len(WORDS.findall(x)) for x in s) >= words:
                    wins.append((k, p, s))
                    first[s] = min(first.get(s, (9,)), place(k, p))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        k = (d, t)
        gone = {p + j for q, p, s in wins if q == k and place(k, p) > first[s] for j in range(len(s))}
        away = {filled[k][i] for i in gone}
        out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in away), len(filled[k]), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("run", "k"), [(3, 2), (2, 1)])
def test_lines(docs, empty, run, k):
    want = brute_lines([r[:2] for r in corpus()], run)
    assert sorted_rows(lines.dedup_lines(docs, run, k), "doc_id", "cut", "n_lines", "n_removed") == want
    assert lines.dedup_lines(empty).count() == 0


def test_lines_short_runs(spark):
    """Repeats on one or two lines: by words with a guarantee of three lines, all of them with one of a line."""
    long, a, b, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("l", 40), ("a", 20), ("b", 20), ("s", 5)))
    rows = [(1, f"{long}\nx1\n{short}"), (2, f"y1\n{long}\ny2\n{short}"), (3, f"{a}\n{b}\nz1"), (4, f"v1\n{a}\n\n{b}"), (5, f"{a}\nu1"), (6, long), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.cut, r.n_removed) for r in lines.dedup_lines(df, words=35).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"y1\ny2\n{short}", 1), 3: (rows[2][1], 0), 4: ("v1\n", 2), 5: (rows[4][1], 0), 6: ("", 1), 7: (None, 0)}
    assert {r.n_removed for r in lines.dedup_lines(df).collect()} == {0}
    assert sorted_rows(lines.dedup_lines(df, 1, 1), "doc_id", "cut", "n_lines", "n_removed") == brute_lines(rows, 1)


@pytest.mark.parametrize("words", [0, 5, 35])
def test_lines_short_runs_on_odd_rows(docs, words):
    want = brute_lines([r[:2] for r in corpus()], 3, words)
    assert sorted_rows(lines.dedup_lines(docs, words=words), "doc_id", "cut", "n_lines", "n_removed") == want


def test_lines_many_in_one_text(spark):
    """A text of 50,000 repeated lines, which once made a task copy its list of lines for each of them."""
    rows = [(1, "\n".join(["the same line"] * 50_000)), (2, "x\nthe same line\nthe same line\nthe same line"), (3, "\n".join(f"line {i} of many" for i in range(50_000)))]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), words=35).collect()}
    assert got == {1: (50_000, 49_999), 2: (4, 3), 3: (50_000, 0)}


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b, shared = (rng.integers(0, 50, n).astype(np.uint64) for n in (30, 40, 6))
        x, y = np.concatenate([a, shared]), np.concatenate([b, shared, a[:3]])
        p, q = (set(textkit.winnowed(z, np.zeros(len(z), np.int64), 3, 4)[1].tolist()) for z in (x, y))
        assert p & q


def brute_components(rows, k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and den * len(x & sets[j]) >= num * len(x | sets[j]):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard(docs, empty):
    want = brute_components([r[:2] for r in corpus()], 4, 85, 100)
    assert sorted_rows(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_families(spark):
    """Chains, a family whose members link with its centre alone, and texts of shared passages that don't link."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    rows, n = [], 0
    centre = [word() for _ in range(100)]
    for _ in range(25):
        w = list(centre)
        w[rnd.randrange(100)] = word()
        w[rnd.randrange(100)] = word()
        rows.append((n, " ".join(w)))
        n += 1
    rows.append((n, " ".join(centre)))
    chain = [word() for _ in range(80)]
    for _ in range(20):
        n += 1
        chain = chain[2:] + [word(), word()]
        rows.append((n, " ".join(chain)))
    passage = [word() for _ in range(40)]
    for _ in range(30):
        n += 1
        rows.append((n, " ".join(passage + [word() for _ in range(20)])))
    got = sorted_rows(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85, 100)


def test_components(spark):
    from pactlake.llm.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200}


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.Ranks.read(f.read().splitlines())
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), ranks


def reference_encoding(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_bpe_matches_library(encoder):
    enc, ranks = encoder
    lib, rnd = reference_encoding(ranks), random.Random(2)
    texts = ["".join(rnd.choice("aabbtheionsrABC  \n\t'é1.!日🎉") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 2000, " " * 300 + "x", "\n" * 70, "<|endoftext|>", "".join(map(chr, range(1, 3000)))]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<i4").tolist() == lib.encode_ordinary(t)


def test_bpe_appends_and_edits(encoder):
    _, ranks = encoder
    lib, rnd = reference_encoding(ranks), random.Random(4)
    p = bpe.Prefixes(ranks, b"internationalisation of everything" * 20)
    for _ in range(60):
        a = rnd.randint(0, len(p.data))
        b = min(len(p.data), a + rnd.randint(0, 6))
        anew = p.replace(a, b, bytes(rnd.choice(b"aeinrst ") for _ in range(rnd.randint(0, 6))))
        p.append(b"ing" if rnd.random() < 0.2 else b"")
        assert p.ids() == lib._encode_single_piece(p.data)
        assert anew <= 6 + 2 * ranks.longest + 200


def test_bpe_documents(docs, empty, encoder):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = reference_encoding(encoder[1])
    coded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "text"))
    rows = bpe.decode_documents(coded, path, keep=("doc_id", "text", "ids")).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and r.ids == lib.encode_ordinary(r.text or "")
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_language_id_held_out(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(d.filter(~held))
    out = langid.predict(d.filter(held), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_odd_rows(docs, empty):
    model = langid.fit(docs)
    assert model.languages == ("en",)
    for r in langid.predict(docs, model, keep=("doc_id", "text")).collect():
        lettered = r.text is not None and any(map(str.isalpha, r.text))
        assert r.lang_pred == ("en" if lettered else "und")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_language_id_brute_force(spark, docs):
    """Predictions are those of plain cosines of 1- to 3-grams with the model's centroids; equal ones go to the first name."""
    texts = [(i, t, "abc"[i % 3]) for i, (_, t, *_) in enumerate(corpus())]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ("a", "b", "c")
    tied = langid.Model(("x", "y"), model.idf, np.concatenate([model.centroids[:1]] * 2), np.array([0, 1]), np.zeros(2))
    for m in (model, tied):
        for r in langid.predict(df, m, keep=("doc_id", "text")).collect():
            raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (r.text or "").encode())
            found = Counter()
            for k in (1, 2, 3):
                for i in range(len(raw) - k + 1):
                    h = 0
                    for j in range(k):
                        h = (h * 0x01000193 + raw[i + j] + j + 1) % 2**32
                    found[h * 0x9E3779B1 % 2**32 >> 20] += 1
            v = {p: np.log1p(n) * float(m.idf[p]) for p, n in found.items()}
            norm = sum(x * x for x in v.values()) ** 0.5
            cosines = [sum(x * float(c[p]) for p, x in v.items()) / norm for c in m.centroids] if v else [0.0]
            if any(map(str.isalpha, r.text or "")):
                assert abs(r.score - max(cosines)) < 1e-4
                assert cosines[[m.languages[k] for k in m.of].index(r.lang_pred)] <= max(cosines) + 1e-4
                assert max(c for c, k in zip(cosines, m.of) if m.languages[k] == r.lang_pred) >= max(cosines) - 1e-4
                assert m is model or r.lang_pred == "x"
            else:
                assert (r.lang_pred, r.score) == ("und", 0.0)


def test_language_id_learns_every_label(spark):
    """Many labels, rare ones and hot copies among them, are all learnt."""
    rows = [(i, f"{chr(97 + i % 26) * 4} {chr(97 + i // 26) * 5} word", f"l{i % 400:03}") for i in range(800)] + [(7, "one text", "hot")] * 900
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3), rows_a_language=40)
    assert set(model.languages) == {f"l{i:03}" for i in range(400)} | {"hot"}


def test_language_vectors_whole_texts():
    long = "ab cd é " * 400_000
    alone = langid.counts(next(textkit.slices(pa.array([long]))))[0]
    beside = langid.counts(next(textkit.slices(pa.array(["zz", long, "q"]), limit=1 << 30)))[1]
    assert (alone == beside).all() and alone.sum() == 3 * len(long.encode()) - 3


def test_lm_scoring(spark, docs, empty):
    good = spark.createDataFrame([(5,), (6,), (7,), (None,), (5,)], "doc_id bigint")
    rows = lmscore.score_documents(docs, good).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert (r.score is None) == (r.n_tokens == 0)
        assert r.score is None or abs(r.score - r.loss_target + r.loss_background) < 1e-9
    near = np.mean([r.score for r in rows if r.doc_id == 7])
    far = np.mean([r.score for r in rows if r.doc_id in (10, 11, 12, 13)])
    assert near < far
    assert lmscore.score_documents(empty, good).count() == 0


def test_lm_losses_brute_force():
    texts = ["a b a b c", "b b a", "", "a"]
    known = np.unique(textkit.Words(next(textkit.slices(pa.array(["a b"]))), textkit.ALNUM).hashes())
    one = next(textkit.slices(pa.array(texts)))
    c, v, mu = lmscore.Coded(one, known), 3, 2.0
    b = 1 << lmscore.BUCKET_BITS
    counts = lmscore.Counts(*(np.stack([np.bincount(x, minlength=n)] * 2) for x, n in ((c.word, v), (c.word[c.second - 1], v), (c.place, b))))
    got = lmscore._losses(c, 4, counts, 1, np.ones(4, bool), mu)
    docs = [[{"a": 0, "b": 1}.get(w, 2) for w in t.split()] for t in texts]
    for i, d in enumerate(docs):
        rest = [x for j, x in enumerate(docs) if j != i]
        uni, pairs, ctx = Counter(w for x in rest for w in x), Counter(p for x in rest for p in zip(x, x[1:])), Counter(w for x in rest for w in x[:-1])
        loss = 0.0
        for j, w in enumerate(d):
            p = (uni[w] + 1) / (sum(uni.values()) + v)
            if j:
                p = (pairs[d[j - 1], w] + mu * p) / (ctx[d[j - 1]] + mu)
            loss -= np.log2(p)
        assert abs(loss - got[i]) < 1e-9


def test_lm_exact_counts(spark, monkeypatch):
    """More words than any fixed table has, in several batches and buckets: losses are those of exact counts of all."""
    monkeypatch.setattr(lmscore, "BUCKET_BITS", 14)
    rnd = random.Random(3)
    docs = [" ".join(f"w{rnd.randrange(60_000)} the" if j % 3 else "Of the" for j in range(200)) for _ in range(600)]
    good = set(range(0, 600, 7))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in lmscore.score_documents(df, spark.createDataFrame([(i,) for i in good], "doc_id bigint")).collect()}
    words = [d.lower().split() for d in docs]
    v, mu = len({w for d in words for w in d}), 8.0
    assert v > 1 << 15
    models = []
    for some in (good, range(600)):
        kept = [words[i] for i in some]
        models.append((Counter(w for d in kept for w in d), Counter(p for d in kept for p in zip(d, d[1:])), Counter(w for d in kept for w in d[:-1])))
    for i in range(0, 600, 5):
        d, losses = words[i], []
        own = (Counter(d), Counter(zip(d, d[1:])), Counter(d[:-1]))
        for (uni, pairs, ctx), less in zip(models, (i in good, True)):
            loss, total = 0.0, sum(uni.values()) - less * len(d)
            for j, w in enumerate(d):
                p = (uni[w] - less * own[0][w] + 1) / (total + v)
                if j:
                    u = d[j - 1]
                    p = (pairs[u, w] - less * own[1][u, w] + mu * p) / (ctx[u] - less * own[2][u] + mu)
                loss -= np.log2(p)
            losses.append(loss / len(d))
        assert got[i].n_tokens == len(d)
        assert abs(losses[0] - got[i].loss_target) < 1e-9 and abs(losses[1] - got[i].loss_background) < 1e-9


def test_warc_round_trip(spark):
    rnd = random.Random(1)
    big = "<p>" + "é" * 1000
    pages = [(i, f"http://a/{i}?q=ä b", "".join(chr(rnd.randint(32, 900)) for _ in range(rnd.randint(0, 5000)))) for i in range(60)]
    pages += [(100, None, big), (101, "u", big), (105, "u\r\nX: y", big), (200, "u", "small"), (201, "u", "small"), (300, "u", None), (301, "u", ""), (None, "u", big), (400, "u", "WARC/1.0\r\n\r\n\x1f\x8b\x08" * 90)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    files = warc.write_archives(df, new_path(spark, "warc"))
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = h == big and i != 105
        want.append((None if i is None else str(i), "revisit" if revisit else "response", "105" if revisit else None, len(raw), hashlib.sha1(raw).hexdigest(), True))
    for split in (1 << 20, 1000, 77):
        out = warc.read_archives(files, split)
        assert sorted_rows(out, "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact") == sorted(want, key=repr)
    assert {bytes(r.payload) for r in out.filter("record_type = 'response' and record_id = '105'").collect()} == {big.encode()}
    none = warc.write_archives(df.limit(0), new_path(spark, "warc"))
    assert warc.read_archives(none).count() == 0


@pytest.mark.parametrize("long", [20_000, 2_000_000])
def test_warc_long_headers_at_every_split(tmp_path, long):
    """Records whose headers are longer than what is read at once are found wherever a range begins, each by one range."""
    rnd = random.Random(4)
    url = "http://a/" + "".join(rnd.choice("abcdefgh0123456789") for _ in range(long))
    parts = [warc.record(str(i), u, b"x" * 50, "d", 50, None, "2024-01-01T00:00:00Z", 4) for i, u in ((1, "u"), (2, url), (3, "v"))]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    cuts = np.cumsum([0, *map(len, parts)]).tolist()
    ids = lambda f, a, b: [warc._row(x, e, False)["record_id"] for x, e in warc.members(f, a, b)]
    splits = range(1, cuts[-1]) if long < 100_000 else [*range(1, cuts[1] + 40), *range(cuts[1] + 1000, cuts[2], 200_000), *range(cuts[2] - 20, cuts[-1])]
    with pa.OSFile(str(path)) as f:
        for at in splits if long > 100_000 else [x for x in splits if x % 37 == 0 or min(abs(x - c) for c in cuts) < 4]:
            assert ids(f, 0, at) + ids(f, at, cuts[-1]) == ["1", "2", "3"]


def test_warc_damaged_members(spark, tmp_path):
    """What is cut off, damaged or no record makes a row with an error; the records around it are read."""
    import gzip

    parts = [warc.record(str(i), "u", bytes(random.Random(i).randbytes(3000)), "d", 3000, None, "2024-01-01T00:00:00Z", 4) for i in range(1, 5)]
    broken = bytearray(parts[1])
    broken[1500:1540] = bytes(40)
    raw = parts[0] + bytes(broken) + gzip.compress(b"no record") + parts[2] + parts[3][:-500]
    (tmp_path / "a.warc.gz").write_bytes(raw)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(raw))], "path string, bytes bigint")
    rows = warc.read_archives(files).collect()
    assert {r.record_id for r in rows if r.error is None} == {"1", "3"}
    assert {r.record_id for r in rows if r.error is not None and r.record_id} == {"2", "4"}


def test_warc_ranges_are_dealt(spark):
    files = spark.createDataFrame([("file:///none", 4500 * 1000)], "path string, bytes bigint")
    assert warc.read_archives(files, 1000).rdd.getNumPartitions() == -(-4500 // warc.RANGES_A_TASK)


def test_warc_odd_columns(spark):
    rows = [(1, "u", "x" * 2000, 5, "a"), (1, "u", "x" * 2000, 5, "a"), (2, None, "x" * 2000, 6, "b"), (3, "v" * 30_000, None, 7, None), (4, "w", "é" * 500_000, None, "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, size bigint, digest string")
    out = warc.read_archives(warc.write_archives(df, new_path(spark, "warc"))).select("record_id", "record_type", "refers_to", "payload_bytes", "error").collect()
    assert sorted(map(tuple, out)) == [("1", "revisit", "2", 2000, None)] * 2 + [("2", "response", None, 2000, None), ("3", "response", None, 0, None), ("4", "response", None, 1_000_000, None)]


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as cp

    assert 4 <= len(cp.STAGES) <= 5
    extra = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(1) for c in ("kept", "n_hit", "rid", "n_removed", "n_lines", "cut", "is_first")})
    both = extra.unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    kept = both
    for _, stage in cp.STAGES[:-1]:
        out = cp.saved(stage(spark, kept, sf_dir), "t")
        assert out.columns == both.columns and 0 < out.count() <= kept.count()
        kept = out
    last = cp.STAGES[-1][1](spark, kept, sf_dir)
    assert last.filter("not decodes").count() == 0 and last.count() == kept.count()
    for _, stage in cp.STAGES:
        assert stage(spark, both.limit(0), sf_dir).count() == 0


def test_near_duplicates_keep_one(spark, docs, sf_dir):
    import corpus_pipeline as cp

    out = cp.near_duplicates(spark, docs, sf_dir).collect()
    want = brute_components([r[:2] for r in corpus()], 5, 80, 100)
    with_words = {c for d, n, c in want if n}
    assert sorted(r.doc_id for r in out if WORDS.search(r.text or "")) == sorted(with_words)
    assert sum(1 for r in out if not WORDS.search(r.text or "")) == sum(1 for _, n, _ in want if not n)


def test_queries_and_sql():
    from pactlake.llm import queries

    q = queries.queries()
    assert {int(k[2:].split("_")[0]) for k in q if k.startswith("op")} == set(range(1, 14)) and "pipeline" in q
    assert set(queries.oracle_sql()) <= set(q)


def test_jaccard_rounds_and_blocks(spark, monkeypatch):
    """Components are the same whatever a text may propose at once and however groups are cut into blocks; links are all links."""
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):  # members of one family, some of which link and some of which nearly do
        w = list(base)
        for at in rnd.sample(range(90), rnd.choice([1, 1, 2, 3])):
            w[at] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows, 4, 85, 100)
    for proposed, block in ((1, 7), (8, 2048)):
        monkeypatch.setattr(jaccard, "PROPOSED", proposed)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert sorted_rows(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == want
    links, members = jaccard.jaccard_links(df)
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    got = {frozenset((r.a, r.b)) for r in links.collect()}
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, w in ((d, t.split()) for d, t in rows)}
    linked = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    assert got == {frozenset((of[a], of[b])) for a in sets for b in sets if of[a] != of[b] and linked(sets[a], sets[b])}
    assert all(of[100 + i] == of[i] for i in range(5))


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for n in (10, 100, 3000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)]))
        a, b = (np.frombuffer(jaccard.sketch(s), dtype=np.uint64) for s in (x, y))
        words = min(len(a), len(b))
        differ = int(np.bitwise_count(jaccard.folded(a, words) ^ jaccard.folded(b, words)).sum())
        assert 0 < differ <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("name", ["op7_line_dedup", "op7_single_lines"])
def test_line_queries_and_sql(spark, sf_dir, name):
    import duckdb
    from pactlake.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted_rows(queries.queries()[name](spark, sf_dir), *want.columns) == sorted(want.fetchall(), key=repr)


def test_few_rounds(spark, monkeypatch):
    """Stars are components at once; few pairs of a block are told whole; no round comes after the last links, and no lookup whose result nothing reads."""
    from pactlake.llm import graph, substrings

    names: list[str] = []
    for module in (graph, jaccard, substrings):
        monkeypatch.setattr(module, "saved", lambda df, name, f=module.saved: (names.append(name), f(df, name))[1])
    stars = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(11, 10), (3, 3)], "a bigint, b bigint")
    assert {r.node: r.root for r in graph.components(stars).collect()} == {i: 0 for i in range(1, 9)} | {11: 10}
    assert names == ["edges"]
    assert not graph.components(stars.filter("a = b")).count()

    # sets of 100 tokens, the last one alone like twelve others that are in components of their own
    words = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.append(words[:-1], np.uint64(10_000 + i)) for i in range(12)] + [words]
    row = lambda i, s, label: {"rid": i, "size": len(s), "label": label, "b": 0, "sketch": jaccard.sketch(s), "heads": jaccard.prefix_bits(s[:20]) * (jaccard.ORDERS - 1)}
    block = jaccard._Block([row(i, s, int(i == 12)) for i, s in enumerate(sets)], 85, 100)
    assert block.proposals(8, True) == ([(12, i) for i in range(12)], False)
    some, more = block.proposals(0, True)
    assert not some and more

    names.clear()
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])) for i in range(0, 90, 9)] + [(1000, "a b c d e"), (1001, "a b c d f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted_rows(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85, 100)
    assert names.count("prefixes") == 1 and names.count("proposed") <= 1


def test_links_that_come_later(spark):
    from pactlake.llm.graph import components, merged

    first, later = [(5, 4), (4, 3), (9, 8), (21, 20)], [(9, 5), (8, 4), (30, 31), (2, 30)]
    frame = lambda some: spark.createDataFrame(some, "a bigint, b bigint")
    told = lambda roots: sorted((r.node, r.root) for r in roots.collect())
    assert told(merged(components(frame(first)), frame(later))) == told(components(frame(first + later)))
