"""Each operator against brute force, over a table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import CLASHES, backoff as slow_backoff, components, decontaminate, documents, frame, line_dedup, order, substrings

from methlake.llm import backoff, bpe, fm_index, language, lines, neighbours, quality, sharding, simhash, substrings as fast
from methlake.llm.queries import ranks


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows, CLASHES).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], CLASHES)


@pytest.mark.parametrize("bucket_bytes", [fast.BUCKET_BYTES, 4000])  # the latter makes many buckets, with hot bins
def test_substrings(docs, rows, bucket_bytes):
    got = fast.dedup(docs, bucket_bytes=bucket_bytes).select("doc_id", "n_words", "n_removed", "kept", "lang").collect()
    assert Counter(tuple(r)[:4] for r in got) == substrings(rows)


def test_substrings_in_hot_bins(docs, rows, monkeypatch):
    monkeypatch.setattr(fast, "REDUNDANCY", 0.001)  # makes every bin hot
    got = fast.dedup(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == substrings(rows)


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fast, "sequence_hashes", lambda h, first, size: np.zeros(len(first), np.uint64))
    texts = [b"a b c", b"a b d", b"a b c", b"a b d"]
    kmers = fast.SuperKmers(np.arange(4), np.arange(4), np.zeros(4, np.int32), np.ones(4, np.int32), pa.array(texts, pa.large_binary()))
    assert fast.losers(kmers, 3)[0].tolist() == [False, False, True, True]


def test_lines(docs, rows):
    got = lines.dedup(docs).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == line_dedup(rows)


def test_lines_whose_likeliest_partner_fails(docs, rows, monkeypatch):
    """Signatures that tell nothing: likeliest partners often fail, so the second pass has to find the right ones."""
    real = lines.match
    monkeypatch.setattr(lines, "match", lambda w, o, th, li, size, pos, a, b, sid, **k: real(w, o, th, li, size, pos, np.zeros_like(a), np.zeros_like(b), sid, **k))
    got = lines.dedup(docs).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == line_dedup(rows)


def test_lines_of_crowded_words(docs, rows, monkeypatch):
    monkeypatch.setattr(lines, "MOST", 2)
    got = lines.dedup(docs).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == line_dedup(rows)


@pytest.mark.parametrize("most", [lines.MOST, 2])
@pytest.mark.parametrize("blind", [False, True])
def test_lines_of_rows_that_share_a_key(spark, monkeypatch, most, blind):
    """Rows of one key (null or not) with different texts but the same line at the same place, like an earlier line."""
    monkeypatch.setattr(lines, "MOST", most)
    if blind:  # as in the test above: the second pass has to find the partners
        real = lines.match
        monkeypatch.setattr(lines, "match", lambda w, o, th, li, size, pos, a, b, sid, **k: real(w, o, th, li, size, pos, np.zeros_like(a), np.zeros_like(b), sid, **k))
    rows = [(1, "a b c d e f g h i j", "en", "s"), (2, "a b c d e f x y z j", "en", "s")]
    rows += [(k, f"a b c d e f g h i k\nown {i}", "en", "s") for k in (None, 7) for i in range(4)]
    want = line_dedup(rows)
    assert sum(c for (k, _, m, _), c in want.items() if m) == 8
    got = lines.dedup(frame(spark, rows)).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == want


def test_lines_of_five_words_at_least(docs, rows):
    got = lines.dedup(docs, least=5).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == line_dedup(rows, least=5)


ITEMS = lambda rows: [(i, t[:90]) for i, t in [(n, x[1]) for n, x in enumerate(rows) if x[1]][:12]] + [(90, None), (91, ""), (92, "The"), (None, rows[5][1]), (93, "no such words at all here"), (92, "... 日本 ...")]


@pytest.mark.parametrize("block", [fm_index.BLOCK_BYTES, 200])
def test_decontamination(spark, docs, rows, block):
    items = ITEMS(rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = fm_index.find(docs, bench, block_bytes=block)
    got = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r.item_ids)) for r in found.collect())
    assert got == decontaminate(rows, items)
    left = fm_index.remove(found)
    again = fm_index.find(left.select("doc_id", "text"), bench).collect()
    assert sum(len(r.spans) for r in again) <= 2 and left.count() == len(rows)


def test_decontamination_draws_a_block_at_a_time(docs, rows, spark, monkeypatch):
    drawn, built = [], []
    blocks, build = fm_index._blocks, fm_index.Phrases.build
    monkeypatch.setattr(fm_index, "_blocks", lambda *a: (drawn.append(1) or b for b in blocks(*a)))
    monkeypatch.setattr(fm_index.Phrases, "build", lambda *a: built.append(len(drawn)) or build(*a))
    fm_index.find(docs, spark.createDataFrame(ITEMS(rows), "item_id int, text string"), block_bytes=200)
    assert len(built) > 2 and built == list(range(1, len(built) + 1))


def test_decontamination_without_items(spark, docs, rows):
    found = fm_index.find(docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert {(len(r.spans), len(r.item_ids)) for r in found.collect()} == {(0, 0)}


def test_bpe(docs, rows):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    known = ranks()
    got = bpe.decode(bpe.encode(docs, known), known).select("text", "ids", "decoded", bpe.unpacked("ids").alias("list")).collect()
    for r in got:
        ids = right.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids == r.list
        assert bytes(r.decoded) == (r.text or "").encode()
    assert len(got) == len(rows)


def test_bpe_of_long_matches():
    import regex

    known = ranks()
    pattern = regex.compile(known.pattern)
    for text in ("ab" * 3000, "é" * 2000, " " * 1500 + "x"):
        flat, _ = bpe.encode_texts([text], pattern, known)
        short = bpe.merge_rows(known.byte_ids[np.frombuffer(pattern.findall(text)[0].encode(), np.uint8)][None, :].copy(), known)
        assert short[0][1][0][short[0][1][0] >= 0].tolist() == bpe.encode_texts([pattern.findall(text)[0]], pattern, known)[0].tolist()
        assert b"".join(known.tokens[i] for i in flat) == text.encode()


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.simhash & (2**64 - 1), r.component) for r in got) == components(rows)


def test_simhash_in_slices(docs, rows):
    got = simhash.near_duplicates(docs, most=2).collect()
    assert Counter((r.doc_id, r.simhash & (2**64 - 1), r.component) for r in got) == components(rows)


def test_trie_links_span_all_pairs():
    rng = np.random.default_rng(0)
    flips = rng.integers(0, 64, (400, 5))
    prints = rng.integers(0, 2**63, 20, dtype=np.uint64)[rng.integers(0, 20, 400)]
    for k in range(5):
        prints = np.where(rng.random(400) < 0.5, prints ^ (np.uint64(1) << flips[:, k].astype(np.uint64)), prints)
    prints = np.unique(prints)
    a, b = simhash.trie_links(np.zeros(len(prints), np.int64), prints[:, None], 4)
    got, want = simhash.Forest(len(prints)), simhash.Forest(len(prints))
    got.join(a, b)
    want.join(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4))
    assert np.array_equal(got.root, want.root)


def test_similar_documents(spark):
    """Texts with few words changed share a component with their original; others, and those with half of them changed, do not."""
    rnd = np.random.default_rng(2)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), 6))
    rows, want = [], {}
    for i in range(40):
        words = [word() for _ in range(300)]
        for j, changes in enumerate((0, 1, 3, 5, 150)):
            copy = list(words)
            for at in rnd.choice(300, changes, replace=False):
                copy[at] = word()
            rows.append((i * 10 + j, " ".join(copy), "en", "s"))
            want[i * 10 + j] = i * 10 if changes < 100 else i * 10 + j
    got = {r.doc_id: r.component for r in simhash.similar_documents(frame(spark, rows), most=16).collect()}
    assert all(got[k] == k for k, v in want.items() if v == k)
    assert np.mean([got[k] == v for k, v in want.items()]) > 0.97
    odd = simhash.similar_documents(frame(spark, documents(), CLASHES)).collect()
    assert len(odd) == len(documents())


def test_similar_documents_are_those_of_the_similarity(spark):
    """Pairs at and above a Jaccard similarity of 0.8 are linked, pairs below it are not, repeated shingles count once."""
    rnd = np.random.default_rng(5)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), 7))
    rows, want = [], {}
    for i in range(300):
        words = [word() for _ in range(104)]  # 100 shingles
        tail = (11, 10, 8, 12, 14)[i % 5]  # of 100 shingles changed at the end: J = 89/111 = 0.802, 0.818, 0.852, 0.786, 0.754
        copy = words[: 104 - tail] + [word() for _ in range(tail)]
        rows += [(i * 2, " ".join(words), "en", "s"), (i * 2 + 1, " ".join(copy), "en", "s")]
        want[i * 2 + 1] = (100 - tail) / (100 + tail) >= 0.8
    got = {r.doc_id: r.component for r in simhash.similar_documents(frame(spark, rows)).collect()}
    linked = {k: got[k] == k - 1 for k in want}
    assert not any(linked[k] for k, w in want.items() if not w)
    assert np.mean([linked[k] for k, w in want.items() if w]) > 0.96
    ends = [" ".join(word() for _ in range(100)) for _ in range(2)]  # "la" five times over is one shingle, and few straddle
    odd = [(1, "la " * 3000 + ends[0], "en", "s"), (2, ends[0], "en", "s"), (3, "la " * 3000 + ends[1], "en", "s")]
    assert {r.doc_id: r.component for r in simhash.similar_documents(frame(spark, odd)).collect()} == {1: 1, 2: 1, 3: 3}


def test_similar_documents_verify_pairs_that_a_failed_link_hides(spark, monkeypatch):
    """A forest as wide as the budget has links that fail; what they hid is compared again."""
    monkeypatch.setattr(simhash, "CLOSE", 0.9999)
    test_similar_documents_are_those_of_the_similarity(spark)
    test_similar_documents(spark)


@pytest.mark.parametrize("most", [4096, 64])
def test_similar_documents_of_one_template(spark, monkeypatch, most):
    """Pages of one template, near the similarity: the right components, from a number of pairs that grows with the pages."""
    rnd = np.random.default_rng(8)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), 7))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rnd.choice(150, rnd.choice([1, 2, 3, 5, 6]), replace=False):
            words[at] = word()
        rows.append((i, " ".join(words), "en", "s"))
    sets = [simhash.shingles(r[1].encode(), 5) for r in rows]
    want = simhash.Forest(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                want.join(np.array([a]), np.array([b]))
    asked, verified = [], simhash._verified

    def counted(*a):
        out = verified(*a)
        asked.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_verified", counted)
    got = {r.doc_id: r.component for r in simhash.similar_documents(frame(spark, rows), most=most).collect()}
    assert np.mean([got[i] == want.root[i] for i in range(len(rows))]) > 0.97
    assert sum(asked) < 30 * len(rows), asked  # not all pairs within the budget


def test_similar_documents_of_a_large_group_make_few_pairs(spark, monkeypatch):
    """Near copies of one text are one label by the time that all tables are met, also where their groups are sliced."""
    rnd = np.random.default_rng(9)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), 7))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rnd.choice(200, 2, replace=False):
            words[at] = word()
        rows.append((i, " ".join(words), "en", "s"))
    made, store = [], simhash.stored

    def counted(df, name):
        out = store(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.doc_id: r.component for r in simhash.similar_documents(frame(spark, rows), most=128).collect()}
    assert set(got.values()) == {0}
    assert sum(made) < 16 * len(rows), made


def test_similar_documents_meet_tables_in_rounds(spark, monkeypatch):
    """What an exchange holds does not grow with the number of tables, and rounds find what one pass over all tables finds."""
    rnd = np.random.default_rng(10)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), 7))
    rows = []
    for i in range(150):
        words = [word() for _ in range(100)]
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join(words[: 100 - i % 12] + [word() for _ in range(i % 12)]), "en", "s")]
    met, make = [], simhash._tables

    def counted(bits, *a):
        met.append((len(bits), a[0], a[-1]))
        return make(bits, *a)

    monkeypatch.setattr(simhash, "_tables", counted)
    found = lambda: {r.doc_id: r.component for r in simhash.similar_documents(frame(spark, rows)).collect()}
    whole = found()
    (tables, *_), = [m for m in met if not m[-1]]
    met.clear()
    monkeypatch.setattr(simhash, "ROUND", 2, raising=False)
    monkeypatch.setattr(simhash, "ROUND_ROWS", 1, raising=False)
    assert found() == whole and 100 < sum(k != v for k, v in whole.items())
    rounds = [m for m in met if not m[-1]]
    assert len(rounds) > 5 and all(m[0] <= 4 for m in rounds)
    assert [x for n, first, _ in rounds for x in range(first, first + n)] == list(range(tables))


def test_stored_leaves_no_exchange_files(spark):
    import time

    from pyspark.sql import functions as F

    from methlake.llm.shared import CLEANUP, stored

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString(",").split(",") if "shuffle_" in x}
    had = files()
    got = stored(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "few")
    for _ in range(50):  # they go beside the job
        if not files() - had:
            break
        time.sleep(0.1)
    assert not files() - had and got.count() == 7 and spark.conf.get(CLEANUP, None) is None


def test_parities_bound_what_differs():
    rnd = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rnd.choice(words, n)) for n in (0, 3, 40, 400, 4000, 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    got = pa.Table.from_batches(simhash._parities(5)(iter([batch])))
    sets = [simhash.shingles(x.encode(), 5) for x in texts]
    assert got["size"].to_pylist() == [len(x) for x in sets]
    odd = [np.frombuffer(x, np.uint8) for x in got["parities"].to_pylist()]
    assert all(np.bitwise_count(odd[a] ^ odd[b]).sum() <= len(sets[a] ^ sets[b]) for a in range(6) for b in range(6))
    assert np.bitwise_count(odd[2] ^ odd[3]).sum() > 0.9 * len(sets[2] ^ sets[3])


def test_backoff(docs, rows):
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in backoff.scores(docs, chunk_bytes=2000, part_ngrams=300).collect()), key=lambda x: (order(x[0]), x[1]))
    want = sorted(slow_backoff(rows), key=lambda x: (order(x[0]), x[1]))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(math.isclose(a[2], b[2], abs_tol=1e-9) for a, b in zip(got, want))


def test_sharding(docs, rows):
    got = sharding.assign(docs, shards=7).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    load = Counter(r.shard for r in got)
    assert max(load.values()) - min(load.values()) <= 1 and set(load) == set(range(7))
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(load[s]))
    places = {}
    for r in got:
        places.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert sum(len(p) - 1 for p in places.values()) <= 7


def test_propagation_gathers_linked_texts(spark):
    """Five families of texts that share a line each: fewer families are cut than by hashing alone."""
    own = lambda f, i: f"family {f} has this very line that all of its members hold\nmember {i} of {f}"
    rows = [(f * 100 + i, own(f, i), "en", "s") for f in range(20) for i in range(10)]
    got = {r.doc_id: r.shard for r in sharding.assign(frame(spark, rows), shards=5, rounds=8).collect()}
    spread = [len({got[f * 100 + i] for i in range(10)}) for f in range(20)]
    assert sum(spread) / 20 < 3.5  # hashing gives 4.5


def test_language(spark, docs, rows):
    rnd = np.random.default_rng(0)
    kinds = {"aa": ["ba", "bo", "bi", "ab", "aba"], "zz": ["zu", "zü", "xu", "uz", "zux"]}
    word = lambda k: "".join(rnd.choice(kinds[k], 3))
    train = [(i, " ".join(word(k) for _ in range(rnd.integers(1, 30))), k, "s") for i in range(300) for k in kinds]
    model = language.fit(frame(spark, [*train, (9000, "abc", None, "s"), (9001, None, "aa", "s"), (9002, "12", "zz", "s")]))
    test = [(i, " ".join(word(k) for _ in range(4)), k, "s") for i in range(200) for k in kinds]
    got = language.predict(frame(spark, test, CLASHES), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98 and np.mean([r.rejected for r in got]) < 0.02
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and all((r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text)) and 0 <= r.score <= 1 for r in got)
    nothing = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_no_rightly_named_text_is_rejected():
    score = np.array([0.2, 0.3, 0.35, 0.4, *np.linspace(0.45, 1, 2000)])
    right = np.array([False, False, True, False, *[True] * 2000])
    threshold = language.rejection(score, right)
    assert (score < threshold).tolist() == [True, True] + [False] * 2002
    assert language.rejection(score, np.ones(2004, bool)) == language.rejection(score, np.zeros(2004, bool)) == 0.0


def test_quality(spark, docs, rows):
    rnd = np.random.default_rng(0)
    good = lambda: " ".join("".join(rnd.choice(list("abcde"), 4)) for _ in range(20))
    made = [(i, good() if i % 2 else good().upper() + " !! !!", "en", "s") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(3, None, 0), (None, 1, 0), (5000, 1, 1), (7, 5, 0)], "doc_id bigint, quality int, toxic int")
    train = frame(spark, made, CLASHES)
    model = quality.fit(train, labels)
    got = quality.score(train, model).where("doc_id >= 400").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.97
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}


def vectors(spark, n=400, size=12, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, size)) * rnd.uniform(0.5, 2, (n, 1))
    x[50:80] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    odd = [(1000, None), (1020, [0.0] * size), (1040, [1.0, None] + [1.0] * (size - 2)), (1060, [math.nan] * size), (1080, [math.inf] + [0.0] * (size - 1)), (1100, [1.0, 2.0]), (None, [1.0] * size), rows[20]]
    return spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>"), x


@pytest.mark.parametrize("parts", [(4000, 2000), (16, 3)])
def test_neighbours(spark, parts):
    df, x = vectors(spark)
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), part_vectors=parts[0], part_queries=parts[1]).collect()
    hit = 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - float(x[q] @ x[r.vec_id])) < 1e-12 and r.vec_id != q for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        s = x @ x[q]
        best = [i for i in np.lexsort([np.arange(400), -s]) if i != q][:20]
        hit += len(set(best) & {r.vec_id for r in mine})
    assert len(got) == 400 and hit / 400 >= 0.9


def test_few_vectors(spark):
    df, _ = vectors(spark)
    few = df.where("vec_id < 9 OR vec_id >= 1000")
    got = neighbours.search(few, few).collect()
    assert Counter(r.query_id for r in got) == {i: 8 for i in range(9)}
    assert neighbours.search(df.where("false"), df).count() == 0


@pytest.mark.parametrize("run", [
    lambda d: fast.dedup(d), lambda d: lines.dedup(d), lambda d: simhash.near_duplicates(d), lambda d: simhash.similar_documents(d), lambda d: backoff.scores(d), lambda d: sharding.assign(d),
    lambda d: fm_index.find(d, d.selectExpr("doc_id AS item_id", "text")), lambda d: bpe.encode(d, ranks()),
    lambda d: language.predict(d, language.fit(d)), lambda d: quality.score(d, quality.fit(d, d.selectExpr("doc_id", "1 AS quality"))),
])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_line_sets_of_flagged_words_only():
    """The second pass sorts only lines that have a wanted word, and its packed stretches are those of `squeeze_all`."""
    from methlake.llm import packing

    text = lines.Lines(pa.array(["a b c\nd e\n\nb f", "g h\nc"]))
    classes = np.zeros(lines.COUNTERS, np.uint8)
    (at, word, first), *rest = lines.line_sets(text, classes, 1)
    assert at.tolist() == [0, 1, 3, 4, 5] and not rest
    flags = np.zeros(lines.FLAGS, bool)
    flags[lines.mix(word[first[4] : first[5]]) % np.uint64(lines.FLAGS)] = True  # "c"
    (some, words, _), *rest = lines.line_sets(text, classes, 1, flags)
    assert some.tolist() == [0, 5] and not rest
    assert words.tolist() == [*word[: first[1]].tolist(), *word[first[4] :].tolist()]
    columns = [np.arange(9), np.arange(9, dtype=np.int32) * 7]
    cut = np.array([0, 2, 8])
    assert packing.squeeze_parts(columns, cut) == [packing.squeeze_all([c[a:b] for c in columns]) for a, b in ((0, 2), (2, 8), (8, 9))]
