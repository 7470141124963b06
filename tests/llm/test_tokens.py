"""Token output, tokenizer alignment and the Merkle manifest against brute force, and on odd rows and broken files."""

import base64
import bisect
import hashlib
import io
import random
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from lodestar.llm import merkle, token_align, token_store

SF = "/root/testdata/sf0.001"


def odd_texts(rng):
    words = ["alpha", "Beta", "gamma,", "ünïcode", "naïve", "é", "日本語", "🙂🙂", "́x", "<|endoftext|>", "<s>", "x'll", "I'm", "--", "0x1F", "a\xa0b", "a b", "a\x1cb", "a\tb", "a\nb", "ΟΔΟΣ", "ŉ", "ﬁ", "İ", "Ärger,", "ÀÖØöøÿ", "ßÞ!?", "co-op"]
    spaced = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "   ", "\n", "\n ", " \n", "\n\n", "\t", " \xa0", "　 "]) for _ in range(n))
    return [None, "", " ", "  ", "   ", "\n", "one", " one", "one ", "  one  two   three    ", "a\n\nb", "a \n b", "▁", "a▁b", "x" * 3000, "-" * 999, "é" * 2000, "\x00\x01", "🙂" * 700, "日本" * 900, *[spaced(rng.randrange(1, 40)) for _ in range(60)], " ".join(words) * 3]


def frame_of(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as key", "2 as n", "'f' as file", "3 as part", "0.5D as n_tokens", "4 as start")


# --- token files ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return token_store.tokenizer_path(token_store.VOCABULARY)


def whole_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [token_store.END]


def test_words_encode_like_whole_texts(encoder, monkeypatch):
    monkeypatch.setattr(token_store, "STRETCH", 50)
    monkeypatch.setattr(token_store, "CACHE", 30)
    own = token_store.WordEncoder(encoder)
    texts = odd_texts(random.Random(1))
    own.meet(texts[:40])
    for text in texts:
        if text is not None:
            assert np.frombuffer(b"".join(own(text)), "<u4").tolist() == whole_ids(encoder, text)[:-1], text


def test_store_holds_every_document(spark, encoder):
    texts = odd_texts(random.Random(2))
    docs = frame_of(spark, texts).unionByName(frame_of(spark, [None, "no id", "no id"]).withColumn("doc_id", token_store.F.lit(None).cast("long"))).repartition(5)
    path = tempfile.mkdtemp(prefix="spark-store-")
    manifest = token_store.write(docs, path, lambda: token_store.WordEncoder(encoder), token_store.END)
    found = token_store.read_all(manifest, path).join(token_store.file_starts(manifest), "file").collect()
    found.sort(key=lambda r: r["before"] + r["start"])
    assert [r["doc_id"] for r in found] == [None, None, None, *range(len(texts))]
    at = 0
    for r in found:
        assert r["before"] + r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert r["made"] == whole_ids(encoder, texts[r["doc_id"]])
    assert sorted(len(r["made"]) for r in found if r["doc_id"] is None) == sorted(len(whole_ids(encoder, t)) for t in (None, "no id", "no id"))
    own = token_store.fetch(manifest, path, spark.createDataFrame([(7,), (7,), (14,), (999,)], "doc_id long")).collect()
    assert {r["doc_id"]: r["ids"] for r in own} == {i: whole_ids(encoder, texts[i]) for i in (7, 14)} and len(own) == 2


def test_empty_store(spark, encoder):
    path = tempfile.mkdtemp(prefix="spark-store-")
    manifest = token_store.write(frame_of(spark, []), path, lambda: token_store.WordEncoder(encoder), token_store.END)
    assert token_store.read_all(manifest, path).count() == 0


def written(docs, monkeypatch, frame=100):
    monkeypatch.setattr(token_store, "FRAME_IDS", frame)
    out = io.BytesIO()
    writer = token_store.Writer(out)
    for doc_id, ids in docs:
        writer.add(doc_id, [np.array(ids, "<u4").tobytes()])
    writer.close()
    return out.getvalue()


def test_frames_are_independent_and_only_wanted_ones_are_read(monkeypatch):
    rng = random.Random(3)
    docs = [(rng.choice([None, i, -i]), [rng.randrange(1 << 32) for _ in range(rng.choice([0, 1, 5, 60, 100, 101, 730]))]) for i in range(80)]
    data = written(docs, monkeypatch)
    reader = token_store.Reader(io.BytesIO(data))
    assert [(int(i) if k else None) for i, k in zip(reader.doc_ids, reader.has_id, strict=True)] == [d for d, _ in docs]
    for i in rng.sample(range(80), 80):
        assert np.frombuffer(b"".join(reader.parts(i)), "<u4").tolist() == docs[i][1]
    for i, (_, ids) in enumerate(docs):
        fresh = token_store.Reader(io.BytesIO(data))
        b"".join(fresh.parts(i))
        assert fresh.read_frames <= -(-len(ids) // 100) + (len(ids) > 100)
    whole = np.concatenate([np.array(ids, "<u4") for _, ids in docs]).tobytes()
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data) == whole  # what any reader sees
    assert (reader.frames[:, 1] <= 400).all()


def test_broken_files_are_refused(monkeypatch):
    data = written([(i, list(range(50))) for i in range(9)], monkeypatch)
    for cut in (0, 5, 30, len(data) - 1):
        with pytest.raises(token_store.BrokenFile):
            token_store.Reader(io.BytesIO(data[:cut]))
    reader = token_store.Reader(io.BytesIO(data))
    for place in (8, int(reader.starts[1]) + 12):  # one changed byte in a frame: that frame is refused, others are read
        bad = bytearray(data)
        bad[place] ^= 0xFF
        broken, seen = token_store.Reader(io.BytesIO(bytes(bad))), []
        for i in range(9):
            try:
                b"".join(broken.parts(i))
                seen.append(i)
            except token_store.BrokenFile:
                pass
        assert 0 < len(seen) < 9


def test_op11_against_whole_texts(spark, encoder):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    at, wanted = 0, []
    for doc_id, text in docs:
        ids = whole_ids(encoder, text)
        wanted.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_store.op11_token_output(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == wanted


# --- alignment --------------------------------------------------------------------------------


class Brute:
    """Groups by a plain walk over the shared ends, on whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = token_store.tokenizer_path(token_align.A_VOCABULARY), token_store.tokenizer_path(token_align.B_VOCABULARY)
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        with open(token_store.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as ranks:  # the same vocabulary, as bytes
            self.a_bytes = {int(n): base64.b64decode(x) for x, n in map(bytes.split, ranks)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        if b"".join(self.a_bytes[i] for i in a) != raw or b"".join(map(self.piece, b)) != raw:
            return []
        out, i, j, pa, pb = [], 0, 0, 0, 0
        while i < len(a):
            own_a, own_b = [a[i]], [b[j]]
            pa, pb, i, j = pa + len(self.a_bytes[a[i]]), pb + len(self.piece(b[j])), i + 1, j + 1
            while pa != pb:
                if pa < pb:
                    own_a.append(a[i])
                    pa, i = pa + len(self.a_bytes[a[i]]), i + 1
                else:
                    own_b.append(b[j])
                    pb, j = pb + len(self.piece(b[j])), j + 1
            out.append((own_a, own_b))
        return out

    def table(self, texts):
        all_groups = [self.groups(t) for t in texts]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in all_groups]
        count = Counter(p for own in links for p in own)
        most = {}
        for (x, _), n in count.items():
            most[x] = max(most.get(x, 0), n)
        for g, own in zip(all_groups, links, strict=True):
            spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(spelled.encode()).hexdigest() if g else "")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("limit", [1 << 26, 4000, 0])
def test_alignment_against_a_walk(spark, monkeypatch, limit):
    brute, texts = Brute(), odd_texts(random.Random(4))
    a, b = token_store.tokenizer_path(token_align.A_VOCABULARY), token_store.tokenizer_path(token_align.B_VOCABULARY)
    found = token_align.align(frame_of(spark, texts).repartition(3), a, b, brute.b.get_piece_size(), limit)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()} == dict(enumerate(brute.table(texts)))


def test_sections_small_caches_and_wide_groups(monkeypatch):
    monkeypatch.setattr(token_align, "SECTION", 60)
    monkeypatch.setattr(token_align, "BATCH", 100)
    monkeypatch.setattr(token_align, "CACHE", 25)
    monkeypatch.setattr(token_align, "WIDE", 2)
    brute, texts = Brute(), [t for t in odd_texts(random.Random(5)) if t]
    aligner = token_align.Aligner(token_align.Pair(*(token_store.tokenizer_path(n) for n in (token_align.A_VOCABULARY, token_align.B_VOCABULARY))))
    for text, wanted in zip(texts, brute.table(texts), strict=True):
        doc = token_align._Document(1)
        for own in token_align.sections(text):
            aligner.align([(doc, own)])
        _, numbers, digest, keys, times = doc.result()
        assert (*numbers, digest) == (*wanted[:4], wanted[6]), text
        assert times.sum() == wanted[3] and len(set(keys.tolist())) == len(keys)


def test_divide_on_random_ends():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 400)
        shared = rng.choice([0.0, 0.02, 0.5, 1.0])
        cuts = {x for x in range(1, n) if rng.random() < shared}
        ea = sorted(cuts | {x for x in range(1, n) if rng.random() < 0.4} | {n})
        eb = sorted(cuts | {x for x in range(1, n) if rng.random() < 0.3} | {n})
        both = sorted(set(ea) & set(eb))
        a1, b1 = [bisect.bisect_right(ea, x) for x in both], [bisect.bisect_right(eb, x) for x in both]
        one = np.zeros(1, np.int64)
        found = token_align.divide(np.array(ea), np.array(eb), one, one + len(ea), one, one + len(eb))
        assert [x.tolist() for x in found] == [[0, *a1[:-1]], a1, [0, *b1[:-1]], b1]


def test_alignment_of_no_rows_and_repeated_rows(spark):
    a, b = token_store.tokenizer_path(token_align.A_VOCABULARY), token_store.tokenizer_path(token_align.B_VOCABULARY)
    assert token_align.align(frame_of(spark, []), a, b, 32000).count() == 0
    same = spark.createDataFrame([(1, "to be"), (1, "to be"), (None, "to be"), (None, None)], "doc_id long, text string")
    found = token_align.align(same, a, b, 32000).collect()
    assert sorted(r["count_sum"] for r in found) == [0, 6, 6, 6] and sum(r["doc_id"] is None for r in found) == 2


# --- Merkle manifest --------------------------------------------------------------------------


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows, forge):
    """rows: (doc_id, source, lang, n_chars, text); returns sorted result rows."""
    leaf = lambda r: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))

    def climb(nodes, ways):
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i in range(len(ways)):
                first = at[i] // 16 * 16
                run = nodes[first : first + 16]
                ways[i].append(("".join(run[: at[i] - first]), "".join(run[at[i] - first + 1 :])))
                at[i] //= 16
            nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        return nodes[0]

    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    tops, held = [], []
    for s in names:
        own = sorted(sources[s], key=lambda x: x[:3])
        ways = [[] for _ in own]
        tops.append(climb([x[2] for x in own], ways))
        held.append((own, ways))
    over = [[] for _ in tops]
    root = climb(tops, over) if tops else None
    out = []
    for (own, ways), top, above in zip(held, tops, over, strict=True):
        for (_, _, digest, r), way in zip(own, ways, strict=True):
            folded = forge(r) or digest
            for left, right in way + above:
                folded = h(left + folded + right)
            out.append((r[0], digest, top, root, h("".join(a + b for a, b in way + above)), folded))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1, 1], [300, 1, 20, 257, 16, 4200], [3] * 40, [2] * 300])
def test_manifest_against_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    names = [None, "", "é", "z", *(f"s{i}" for i in range(300))]
    rows = [(None if rng.random() < 0.01 else rng.randrange(-5, 3 * n), name, rng.choice([None, "", "de"]), rng.choice([None, 0, 12]), rng.choice([None, "", "Ab", "ab", "X" * 40, "ü"])) for n, name in zip(sizes, names, strict=False) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as tree", "2 as key", "'x' as digest", "3 as pos", "4 as n", "5 as block", "6 as g")
    forged = merkle.F.when(merkle.F.crc32(merkle.F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf([merkle.F.lower("text") if f == "text" else merkle.F.col(f) for f in merkle.FIELDS]))
    forge = lambda r: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], r[4] and r[4].lower()))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None
    found = sorted(map(tuple, merkle.manifest(df.repartition(7), forged).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()), key=str)
    assert found == brute_manifest(rows, forge)


def test_manifest_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df).count() == 0
