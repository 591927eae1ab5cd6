"""Periodic runs, SentencePiece ids and the prefix trie against brute force, the library and plain Python; and rows in bulk."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from llm_cases import CLASHES, WORD, documents, frame, line_dedup, sha, substrings

import corpus_pipeline
from methlake.llm import backoff, lines, piece_bpe, prefix_trie, runs, substrings as fast
from methlake.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows, [*CLASHES, "runs", "collapsed", "differs"]).cache()


# ---- periodic runs


def slow_runs(w, least=24, exponent=3):
    """(start, length, period) of all runs, period by period."""
    found, w = [], np.unique(np.array(w, object).astype(str), return_inverse=True)[1] if len(w) else np.zeros(0, int)
    for p in range(1, len(w) // exponent + 1):
        same = np.concatenate([[False], w[p:] == w[:-p], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2]):
            length = int(b - a + p)
            if length >= max(least, exponent * p) and not any((w[a + q : b + p] == w[a : b + p - q]).all() for q in range(1, p)):
                found.append((int(a), length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(seed=2, n=80):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice("a b c é 日 x\x00".split(" ")) for _ in range(rnd.choice([0, 1, 20, 90]))]
        for _ in range(rnd.randint(0, 3)):
            root = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
            words += root * rnd.randint(2, 12) + root[: rnd.randint(0, len(root))] + [rnd.choice("abcd")]
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(words), "en", "s"))
    return out + [(900, "la " * 4000, "en", "s"), (901, " ".join("ab"[bin(k).count("1") % 2] for k in range(4096)) * 3, "en", "s"), (None, "x y " * 30, "en", "s"), (902, None, "en", "s"), (903, "", "en", "s")]


def check_runs(df, rows):
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in df.collect())
    want = Counter()
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        found = slow_runs(w)
        want[k, len(w), tuple(found), collapsed(w, found)] += 1
    assert got == want


@pytest.mark.parametrize("side_by_side", [1, runs.SIDE_BY_SIDE, 10**6])
def test_runs(spark, monkeypatch, side_by_side):
    """All texts side by side in numpy, as they come, and each by itself. The Thue-Morse text defeats hashes modulo 2^64."""
    monkeypatch.setattr(runs, "SIDE_BY_SIDE", side_by_side)
    rows = periodic()
    w = [WORD.findall(t or "") for _, t, *_ in rows]
    ids = np.unique([x for d in w for x in d] or [""], return_inverse=True)[1].astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(d) for d in w])]).astype(np.int64)
    owner, start, length, period = runs.runs_of(ids, first)
    assert list(zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist())) == [(k, *r) for k, d in enumerate(w) for r in slow_runs(d)]


def test_runs_of_rows(spark, docs, rows):
    some = periodic()
    check_runs(runs.find(frame(spark, some, ["runs", "n_words", "collapsed"])), some)
    got = runs.find(docs)
    check_runs(got, rows)
    assert got.columns == [c for c in docs.columns if c not in ("runs", "collapsed", "n_words")] + ["n_words", "runs", "collapsed"]


def test_lyndon_words_by_both_ways():
    rnd = random.Random(4)
    for _ in range(60):
        texts = [[rnd.randrange(rnd.choice([1, 2, 5])) for _ in range(rnd.choice([0, 1, 7, 40]))] for _ in range(12)]
        want = []
        for w in texts:
            for i in range(len(w)):
                j = i + 1
                while j < len(w) and w[i:] < w[j:]:
                    j += 1
                want.append(j - i)
        flat, first = np.array([x for w in texts for x in w], np.int64), np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        assert runs.lyndon(flat, first).tolist() == want
        assert [x for w in texts if w for x in runs.lyndon_of_one(np.array(w)).tolist()] == want


def test_extensions_without_hashes(monkeypatch):
    """Hashes that find everything equal: runs are extended anew, word by word."""
    monkeypatch.setattr(runs.Extensions, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    for w in ("ab" * 20 + "c", "c" + "abc" * 12 + "ab" + "d" * 30):
        owner, start, length, period = runs.runs_of(np.array([ord(c) for c in w]), np.array([0, len(w)]))
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == slow_runs(list(w))


def test_op12(spark):
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(WORD.findall(r.text or ""))
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = slow_runs(w)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(r.doc_id, len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(collapsed(w, found).encode()))] += 1
    got = QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want and sum(k[1] > 0 for k in want) > 5


# ---- SentencePiece ids


def awkward_texts():
    rnd = random.Random(3)
    some = list("aabcdetheinr   \t\n▁.,0123éüñß日本語😀́\x00\xa0　​") + ["the", " ing", "    ", "\n\n"]
    return ["", " ", "  ", "▁", "a" * 5000, " " * 999, "ab" * 3000, "日" * 300 + "\U0010ffff" * 70] + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 90))) for _ in range(3000)]


def test_pieces_are_the_librarys():
    library, known = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.Vocabulary.load(MODEL)
    texts, agendas = awkward_texts(), piece_bpe.Agendas(known)
    for text, ids, want in zip(texts, piece_bpe.encode_texts(texts, agendas), library.encode(texts, add_bos=True, add_eos=True)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == want and piece_bpe.decode_ids(ids, known) == library.decode(want)
        marked = piece_bpe.BLANK + text.replace(" ", piece_bpe.BLANK)
        assert not text or known.merged(marked) == want[1:-1]  # the agenda in a heap
    rnd = random.Random(5)
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259), rnd.randrange(3), 28705, 259]) for _ in range(rnd.randint(0, 7))]
        assert piece_bpe.decode_ids(np.array(ids, int), known) == library.decode(ids), ids


def test_other_models_are_refused(tmp_path):
    raw = open(MODEL, "rb").read()
    at = raw.rindex(b"identity")
    (tmp_path / "other.model").write_bytes(raw[:at] + b"nmt_nfkc" + raw[at + 8 :])
    with pytest.raises(ValueError):
        piece_bpe.Vocabulary.load(str(tmp_path / "other.model"))


def test_encode_and_decode_rows(spark, docs, rows):
    known = piece_bpe.Vocabulary.load(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = piece_bpe.decode(piece_bpe.encode(docs, known, check=MODEL), known)
    assert got.columns == [c for c in docs.columns if c not in ("ids", "decoded", "differs")] + ["ids", "differs", "decoded"]
    want = Counter((k, np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes(), False, library.decode(library.encode(t or ""))) for k, t, *_ in rows)
    assert Counter((r.doc_id, bytes(r.ids), r.differs, r.decoded) for r in got.collect()) == want
    assert piece_bpe.differences(docs, MODEL).count() == 0
    assert piece_bpe.encode(docs.where("false"), known).count() == 0


def test_op11(spark):
    library, want = sentencepiece.SentencePieceProcessor(model_file=MODEL), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())] += 1
    assert Counter(tuple(r) for r in QUERIES["op11_piece_bpe"](spark, SF).collect()) == want


# ---- the trie of conversations


def slow_trie(convs):
    """convs: conv_id -> list of (role, text). Nodes as the query returns them."""
    at = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            at[tuple(convs[c][:d])].append(c)
    kids = Counter(p[:-1] for p in at if p)
    leaves, saved = Counter(), Counter()
    for p, who in at.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in at[p] if len(convs[c]) == len(p)).encode()).hexdigest()
    return Counter((who[0], len(p), at[p[:-1]][0] if p else None, len(who), kids[p], leaves[p], saved[p], ends(p)) for p, who in at.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed=1, n=120):
    rnd = random.Random(seed)
    turn = lambda: (rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "é", "", None, "long answer", "x,y"]))
    stems = [[turn() for _ in range(rnd.randint(0, 14))] for _ in range(8)]
    out = {}
    for c in range(n):
        stem = rnd.choice(stems)
        out[c * rnd.choice([1, 3])] = stem[: rnd.randint(0, len(stem))] + [turn() for _ in range(rnd.choice([0, 0, 1, 5]))]
    for c in range(1000, 1030):
        out[c] = stems[0]
    return {c: t for c, t in out.items() if t}


def rows_of(convs):
    rows = [(c, i if i else None, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    return rows


def plain(convs):
    return {c: [(r or "", t or "") for r, t in turns] for c, turns in convs.items()}


@pytest.mark.parametrize("block,span", [(4, 4096), (1, 2), (3, 1)])
def test_trie(spark, monkeypatch, block, span):
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    monkeypatch.setattr(prefix_trie, "PACKED", 3)
    convs = conversations()
    df = spark.createDataFrame(rows_of(convs) + [(None, 1, "user", "no conversation")], "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'clash' AS depth", "1 AS n")
    turns = prefix_trie.turns_of(df)
    members = turns.groupBy("conv_id").agg({"n": "max"}).withColumnRenamed("max(n)", "n")
    none = spark.createDataFrame([(5000, 0), (5001, 0)], "conv_id bigint, n bigint")
    got = prefix_trie.trie(turns, members.unionAll(none), block)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == slow_trie(plain(convs) | {5000: [], 5001: []})


def rebuilt(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    return out


def test_op13_over_awkward_rows(spark, tmp_path):
    """Repeated rows are turns of their own; one very long conversation; no rows at all."""
    convs = conversations(3) | {2000: [("user", "again")] * 40, 2001: [("user", "again")] * 300}
    df = spark.createDataFrame(rows_of(convs), "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == slow_trie(rebuilt(plain(convs)))
    df.where("false").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op13_prefix_trie"](spark, f"{tmp_path}/none").collect() == []


# ---- rows in bulk


def test_many_rows_that_repeat_each_other(spark):
    """5,000 null-key copies of one text, others of its windows and lines: linear work, and the results of brute force."""
    rnd = random.Random(7)
    text = "\n".join(" ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(12)) for _ in range(6))
    other = "one line of its own\n" + "\n".join(text.split("\n")[2:])
    few = [(1, text, "en", "s"), (9, other, "en", "s"), (None, other, "en", "s")]
    df = frame(spark, [*few, *[(None, text, "en", "s")] * 5000])
    for got, slow in ((fast.dedup(df).select("doc_id", "n_words", "n_removed", "kept"), substrings), (lines.dedup(df).select("doc_id", "n_lines", "n_removed", "kept"), line_dedup)):
        want, one = slow([*few, (None, text, "en", "s")]), slow([(1, text, "en", "s"), (None, text, "en", "s")])
        want[next(k for k in one if k[0] is None)] += 4999
        assert Counter(tuple(r) for r in got.collect()) == want
    scores = backoff.scores(df).collect()
    assert len(scores) == 5003 and len({round(r.log_score, 6) for r in scores if r.n_words == 72}) == 1


def test_null_keys_whose_text_hashes_nearly_agree(spark):
    """Two texts whose 64-bit hashes share their low 32 bits stay apart."""
    from pyspark.sql import functions as F

    made = spark.range(300_000).select(F.concat(F.lit("own words number "), F.col("id").cast("string")).alias("t"))
    low = made.withColumn("h", F.xxhash64("t").bitwiseAND(F.lit((1 << 32) - 1))).groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").first()
    pair = (low.a, low.b)
    rows = [(1, pair[0], "en", "s"), (None, pair[0], "en", "s"), (None, pair[1], "en", "s")]
    got = lines.dedup(frame(spark, rows)).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == line_dedup(rows)


# ---- near copies through the pipeline


def test_near_copies_leave_the_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(10)) for _ in range(20)) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    for i in range(20):  # two words changed in each of three lines, which stay: 18 of 196 shingles, similarity about 0.83
        parts = [x.split(" ") for x in texts[i].split("\n")]
        for p in parts[:3]:
            p[4:6] = word(), word()
        rows.append((1000 + i, "\n".join(" ".join(p) for p in parts), "en", "s", 1))
    rows += [(None, texts[1], "en", "s", 1), (2000, texts[2], "en", "s", 1), (None, "nothing like it at all here my friend", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    cut = stages["line_dedup"](spark, docs, str(tmp_path)).cache()
    assert {1000 + i for i in range(20)} <= {r.doc_id for r in cut.collect()}  # remnants
    left = [r.doc_id for r in stages["near_dedup"](spark, cut, str(tmp_path)).collect()]
    assert sorted(x for x in left if x is not None) == list(range(60)) and left.count(None) == 1


def _near_dedup_after_line_dedup(spark, path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    cut = stages["line_dedup"](spark, spark.read.parquet(f"{path}/documents.parquet"), str(path)).cache()
    return [r.doc_id for r in cut.collect()], [r.doc_id for r in stages["near_dedup"](spark, cut, str(path)).collect()]


def test_near_copies_whose_ids_repeat_or_are_null_leave_too(spark, tmp_path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(10)) for _ in range(20)) for _ in range(12)]

    def near(text):
        parts = [x.split(" ") for x in text.split("\n")]
        for p in parts[:3]:
            p[4:6] = word(), word()
        return "\n".join(" ".join(p) for p in parts)

    twice = near(texts[6])
    copies = [(None, near(texts[0])), (None, near(texts[1])), (None, near(texts[2])), (500, near(texts[3])), (500, near(texts[4])), (600, twice), (600, twice)]
    rows = [(k, t, "en", "s", len(t)) for k, t in [*enumerate(texts), *copies]]
    cut, left = _near_dedup_after_line_dedup(spark, tmp_path, rows)
    assert cut.count(None) == 3 and cut.count(500) == cut.count(600) == 2  # remnants
    assert sorted(left, key=str) == sorted(range(12), key=str)


def test_what_is_left_of_different_texts_is_compared(spark, tmp_path):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 8)))
    block = lambda: [" ".join(word() for _ in range(10)) for _ in range(30)]
    a, b, words = block(), block(), [word() for _ in range(140)]
    wrapped = lambda n: [" ".join(words[i : i + n]) for i in range(0, len(words), n)]
    texts = ["\n".join(x) for x in (a, b, a + wrapped(10), b + wrapped(7), block())]
    cut, left = _near_dedup_after_line_dedup(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    assert sorted(cut) == [0, 1, 2, 3, 4] and sorted(left) == [0, 1, 2, 4]
