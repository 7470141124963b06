"""Each operator against brute force on small tables, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import base64
import bz2
import gzip
import hashlib
import io
import lzma
import random
import re
import sys
import tarfile
import tempfile
import time
import warnings
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pytest

from lodestar.llm import decontaminate, embed_dedup, html_extract, jaccard_join, language_id, mixing, quality_mil, secret_scan, substring_dedup, url_filter
from lodestar.llm.common import connected_components

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "so", "ta", "ru") for b in ("ra", "te", "ni", "mo", "lu", "pa", "si", "do")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def docs_of(spark, rows, more=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 as rid", "2 as fp", "'x' as key", "0.5D as score", "3 as node", "4 as n") if more else df


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def odd_rows(rng):
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"), (None, "no id here at all"), (7, prose(rng, 30_000)), (8, "é" * 5000), (9, "\x00\u2028 \U0001f600")]


# --- connected components ---------------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, x) for x in range(5001, 5100)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in found:
        seen, stack = {node}, [node]
        while stack:
            for y in near[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        assert found[node] == min(seen)
    assert set(found) == {x for a, b in edges if a != b for x in (a, b)}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 1 ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy <b>now</b></div><div id="cookie-notice">We use cookies</div>
<header>Site name</header><article class="post comments-open"><header><h1>A &amp; B</h1><span>by x</span></header><p>First   para
with&nbsp;space.<br>More</p><p>Second &lt;b&gt; <b>bold</b> &#233;<p>Third<!-- <p>gone</p> --><form><input> Ask</form>
<ul class="share"><li>Tweet</li></ul><section class="comments"><p>I disagree</p></section></article><aside>Side</aside><footer>&copy;</footer></body></html>"""


def test_main_text_of_an_article(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", PAGE), (2, "http://a.com/2", None), (3, None, ""), (3, None, ""), (4, "u", "plain & text"), (5, "x://h/", "<article><p>cut of"), (None, "x://h/", "<main>m<p>n</main>o")], "page_id long, url string, html string")
    got = html_extract.extract(pages.selectExpr("*", "'z' as host", "1 as rid")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 7
    assert text[1] == "A & B\nFirst para with space. More\nSecond <b> bold é\nThird"
    assert (text[2], text[3], text[4], text[5], text[None]) == ("", "", "plain & text", "cut of", "m\nn")
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_repeated_runs_of_pages_without_article(spark):
    rng = random.Random(5)
    menu = "Home News Sport Weather Contact About Imprint Help"
    rows = [(i, f"http://h.org/{i}", f"<div>{menu}</div><div>{prose(rng, 30)} number {i}</div>") for i in range(6)] + [(99, "http://other.org/", f"<div>{menu}</div>")]
    text = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[i] == rows[i][2].split("<div>")[2].removesuffix("</div>") for i in range(6))
    assert text[99] == menu


def test_no_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def uncovered_by_hand(pages):
    """Brute force over a host's pages (id, blocks): for each depth every run of so many tokens, with the pages that hold it."""
    streams = [(i, [(w, k) for k, t in enumerate(blocks) for w in t.split()]) for i, blocks in pages]
    ids = {i for i, _ in pages}
    out = []
    for _, tokens in streams:
        gone = set()
        for depth, share in html_extract.RUNS:
            for at in range(len(tokens) - depth + 1):
                run = [w for w, _ in tokens[at : at + depth]]
                holders = {j for j, other in streams if any([w for w, _ in other[x : x + depth]] == run for x in range(len(other) - depth + 1))}
                if len(holders) >= max(html_extract.MIN_PAGES, share * len(ids)):
                    gone.update(range(at, at + depth))
        left = {}
        for k, (w, block) in enumerate(tokens):
            if k not in gone:
                left.setdefault(block, []).append(w)
        out.append(("\n".join(" ".join(v) for _, v in sorted(left.items())), len(gone)))
    return out


def test_repeated_runs_match_brute_force(spark):
    rng = random.Random(7)
    chance, long = [prose(rng, 7) for _ in range(3)], prose(rng, 26)
    blocks = []
    for i in range(90):  # phrases of 7 words on few of many pages stay, a run of 26 words on three goes, a menu on all goes
        own = [prose(rng, 12)]
        own += ["Home News Sport Weather Contact About Imprint"] if i % 9 else []
        own += [f"{prose(rng, 4)} {chance[i % 3]} {prose(rng, 4)}"] if i < 9 else []
        own += [long + " " + prose(rng, 3)] if i in (20, 40, 60) else []
        rng.shuffle(own)
        blocks.append((i if i < 80 else 79, own))  # one page many times over
    rows = [(i, "http://h.org/x", "".join(f"<div>{t}</div>" for t in own)) for i, own in blocks]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = uncovered_by_hand(blocks)
    assert sorted((r["page_id"], r["text"], r["n_repeated"]) for r in got) == sorted((i, *w) for (i, _), w in zip(blocks, want, strict=True))
    text = {r["page_id"]: r["text"] for r in got}
    assert chance[0] in text[0] and long not in text[40] and "Weather" not in text[1]


def test_a_page_many_times_over_is_one_page(spark):
    menu = "Home News Sport Weather Contact About Imprint Help"
    rows = [(1, "http://h.org/", f"<div>{menu}</div>")] * 5 + [(2, "http://h.org/", f"<div>{menu}</div>")]
    assert {r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {menu}


@pytest.mark.parametrize("part", ["<a '", "<a ", "<![CDATA[", "<!--", "<script>", "<b x=\"", "<a '>'", "</b>", "<a>", "<div><i>", "<p>x</i>", "&amp", "<", "x<y "])
def test_hostile_pages_take_time_in_proportion(part):
    spent = []
    for size in (1 << 20, 1 << 22):
        page = "<article>" + part * (size // len(part)) + "<div class='" + "x" * 1000
        began = time.process_time()
        html_extract.blocks_of(page)
        spent.append(time.process_time() - began)
    assert spent[1] < 40 and spent[1] < 10 * spent[0] + 1


# --- 2 ----------------------------------------------------------------------------------------

TOKEN = 'token = "abc123DEF456"'


def base_by_hand(text):
    """The three patterns, as stated, dropping failing matches."""
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_base_patterns():
    rng = random.Random(1)
    parts = ["token", "secret=", "PassWord:", "api_key", "apikey", "'", '"', " ", "=", ":", "abc", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "ſecret=abcdefgh", "toKen=abcdef", "é", "%41", "\\u0041"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert sorted(secret_scan.base_spans(text)) == sorted(base_by_hand(text))


@pytest.mark.parametrize(
    "inner",
    [
        quote(TOKEN, safe=""),
        "".join(f"\\u{ord(c):04x}" for c in TOKEN),
        "".join(f"&#{ord(c)};" for c in TOKEN),
        base64.b64encode(TOKEN.encode()).decode(),
        base64.urlsafe_b64encode(TOKEN.encode()).decode().rstrip("="),
        base64.b64encode(gzip.compress(TOKEN.encode())).decode(),
        base64.b64encode(base64.b64encode(TOKEN.encode())).decode(),
        quote(base64.b64encode(gzip.compress(base64.b64encode(TOKEN.encode()))).decode(), safe=""),
        quote(quote(TOKEN, safe=""), safe=""),
    ],
)
def test_nested_secrets_are_found_and_mapped(inner):
    text = f"é words before {inner} and after"
    base, spans, layers, cut = secret_scan.scan(text)
    assert not [x for x in base if x[0] == "assign"] and layers >= 1 and not cut
    start, end = next((s, e) for k, s, e in spans if k == "assign")
    at = text.index(inner)
    assert at <= start < end <= at + len(inner)


def wrapped(text):
    return base64.b64encode(text.encode()).decode()


@pytest.mark.parametrize(
    "copies",
    [
        [wrapped(wrapped(TOKEN))] * 2,
        [wrapped(wrapped(wrapped(TOKEN)))] * 3,
        [wrapped(quote(TOKEN, safe=""))] * 2,
        [wrapped("".join(f"\\u{ord(c):04x}" for c in TOKEN))] * 2,
        [wrapped("x " + wrapped(TOKEN) + " one"), wrapped("y " + wrapped(TOKEN) + " two")],
        [quote(wrapped(wrapped(TOKEN)), safe=""), wrapped(wrapped(TOKEN))],
    ],
)
def test_every_copy_of_a_nested_secret_is_found(spark, copies):
    text = "rows: " + " and ".join(copies) + " end"
    spans = {(s, e) for k, s, e in secret_scan.scan(text)[1] if k == "assign"}
    at, want = 0, []
    for copy in copies:
        start = text.index(copy, at)
        at = start + len(copy)
        want.append((start, at))
    assert all(any(s <= a and b <= e for a, b in spans) for s, e in want)
    left = secret_scan.redact(docs_of(spark, [(1, text)])).first()["text"]
    assert left.count("[REDACTED]") == len(copies) and not any(c in left for c in copies)


def packed(data):
    return base64.b64encode(data).decode()


def tarred(data):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        info = tarfile.TarInfo("a")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize(
    "inner",
    [
        lambda: packed(gzip.compress(tarred(TOKEN.encode()))),
        lambda: packed(gzip.compress(b"first") + gzip.compress(TOKEN.encode())),
        lambda: packed(b"\xff\xfe " + TOKEN.encode()),
        lambda: packed(gzip.compress(b"\n" * (33 << 20) + TOKEN.encode())),
        lambda: "files/v1/" + packed(TOKEN.encode()),
        lambda: "files/v1/" + packed(gzip.compress(TOKEN.encode())),
    ],
)
def test_secrets_deep_in_decoded_bytes_are_found(inner):
    run = inner()
    text = f"words {run} end"
    _, spans, _, cut = secret_scan.scan(text)
    start, end = max(((s, e) for k, s, e in spans if k == "assign"), key=lambda x: x[1] - x[0])
    assert 6 <= start < end <= 6 + len(run) and not cut


def lined(run, width, end="\n"):
    return end.join(run[i : i + width] for i in range(0, len(run), width))


SECRET = "password=hunter2222x"


@pytest.mark.parametrize(
    "inner",
    [
        "x" + wrapped(SECRET),
        "xy" + wrapped(SECRET),
        "xyz" + wrapped(SECRET),
        "xyzw" + packed(gzip.compress(SECRET.encode())),
        "x" + packed(zlib.compress(SECRET.encode())),
        packed(b"\x00\x01 head" + bz2.compress(SECRET.encode()) + b" tail"),
        packed(gzip.compress(b"head " + lzma.compress(SECRET.encode()))),
        "key-" + packed(gzip.compress(SECRET.encode() * 3)) + "/tail/of/path",
        lined(wrapped("some words before the " + SECRET + " and some behind it"), 48),
        lined(wrapped("padding of a few words, then " + SECRET), 48, "\r\n"),
        lined(wrapped(SECRET), 8),
        "xyz" + lined(wrapped("of a line end " + SECRET), 20, "\n    "),
    ],
)
def test_secrets_at_any_place_of_a_run(spark, inner):
    text = f"(words) {inner} (end) {lined('plain', 3)}"
    _, spans, _, cut = secret_scan.scan(text)
    at = text.index(inner)
    assert any(k == "assign" and at <= s < e <= at + len(inner) for k, s, e in spans) and not cut


def test_random_nesting_over_phases_and_widths():
    rng = random.Random(31)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(300):
        data = "".join(rng.choice("words and ") for _ in range(rng.randrange(30))) + " " + SECRET
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(4)
            raw = data.encode()
            if kind == 1:
                raw = rng.choice((gzip.compress, zlib.compress, bz2.compress, lzma.compress))(raw)
            elif kind == 2:
                raw = bytes(rng.randrange(256) for _ in range(rng.randrange(9))) + b"\n" + zlib.compress(raw)
            run = base64.b64encode(raw).decode()
            if kind == 3:
                run = quote(run, safe="")
            elif rng.random() < 0.5:
                run = lined(run, rng.randrange(5, 100), rng.choice(("\n", "\r\n")))
            data = "".join(rng.choice(letters) for _ in range(rng.randrange(5))) + run
        text = f"see: {data} ."
        assert any(k == "assign" and 5 <= s < e <= 5 + len(data) for k, s, e in secret_scan.scan(text)[1]), text


def test_words_on_lines_take_time_in_proportion():
    for text in ("word\n" * 200_000, "abcdefghijklmnop\n" * 50_000, "Q" * 1_000_000, ("Q" * 70 + "\n") * 10_000 + "(", packed(b"x\x9c" * 100_000)):
        began = time.time()
        assert not secret_scan.scan(text)[1]
        assert time.time() - began < 20


def test_long_text_keeps_all_escape_layers():
    inner = quote(quote(quote(TOKEN, safe=""), safe=""), safe="")
    text = "word " * (12 << 18) + inner
    _, spans, _, cut = secret_scan.scan(text)
    assert any(k == "assign" and s >= len(text) - len(inner) for k, s, _ in spans) and not cut


def test_runs_that_were_not_read_are_redacted(spark):
    bomb = packed(gzip.compress(b"a\n" * (secret_scan.MAX_DECODED // 2 + 10)))
    rows = docs_of(spark, [(1, f"x {bomb} y")])
    assert secret_scan.redact(rows).first()["text"] == "x [REDACTED] y"
    rows.write.parquet(path := tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/documents.parquet")
    assert secret_scan.op2_secret_scan(spark, path.rsplit("/", 1)[0]).first()["truncated"]


def test_cycles_and_bombs_end():
    assert secret_scan.scan("%2525" * 50)[2] < 60
    bomb = base64.b64encode(gzip.compress(b"a" * (secret_scan.MAX_DECODED + 10))).decode()
    assert secret_scan.scan(bomb)[3]


def test_escaped_bytes_are_read_where_they_are_no_text():
    escaped = lambda t: "".join(f"%{b:02x}" for b in t.encode())
    secret = "password=hunter2secret"
    for inside in ("%FF" + escaped(secret), escaped("é" + secret) + "%fe%ff", escaped(secret) + "%C3"):
        spans = secret_scan.scan(f"aa {inside} bb")[1]
        assert len(spans) == 1 and inside[min(s for _, s, _ in spans) - 3 :].startswith(escaped("p"))
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        run = quote(pack(b"nothing") + pack(secret.encode())) if pack is gzip.compress else quote(pack(secret.encode()))
        assert ("assign", 3, 3 + len(run)) in secret_scan.scan(f"aa {run} bb")[1]
    for hostile in ("%FF", "x%9c", "BZh%41", "%1f%8b", "BZh91AY", "%"):
        began = time.time()
        secret_scan.scan(hostile * 40_000)
        assert time.time() - began < 20


def test_a_missing_reader_leaves_the_run_unread(monkeypatch):
    monkeypatch.setitem(sys.modules, "zstandard", None)
    run = base64.b64encode(b"\x28\xb5\x2f\xfd" + bytes(range(40))).decode()
    assert secret_scan.scan(f"a {run} b")[3]


def test_secret_rows(spark):
    rng = random.Random(2)
    rows = [*odd_rows(rng), (20, f"x {TOKEN} " + "a1" * 12), (21, prose(rng, 20_000) + " " + TOKEN)]
    got = secret_scan.find_secrets(docs_of(spark, rows, True)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[1]["spans"] == ""
    assert (by[20]["n_assign"], by[20]["n_hex"], by[20]["spans"]) == (1, 1, f"assign:2:{2 + len(TOKEN) - 1},hex:{3 + len(TOKEN)}:{3 + len(TOKEN) + 24}")
    assert by[21]["n_assign"] == 1
    assert secret_scan.find_secrets(docs_of(spark, [])).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"a {TOKEN} b", 99), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = rows_of(secret_scan.redact(df))
    assert got[1]["text"] == 'a [REDACTED]" b' and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("clean", 5, None)


# --- 3 ----------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "zz"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # so that entries are cut into blocks
    rng = random.Random(seed)
    rows = []
    for size in (3, 8, 12, 20, 40, 90, 150, 400):
        base = prose(rng, size)
        for _ in range(14):
            base_now = changed(rng, base, rng.choice([0, 0, 1, 1, 2, 3, max(1, size // 60)]))
            base = base_now if rng.random() < 0.4 else base
            rows.append((len(rows), base_now.upper() if rng.random() < 0.2 else base_now))
    rows += [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, "b a"), (1006, "a b")]
    rng.shuffle(rows)
    want = brute_components(rows)
    got = jaccard_join.components(docs_of(spark, [*rows, rows[0]], True)).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_segments_find_all_pairs_within_the_bound():
    rng = np.random.default_rng(4)
    for n in (10, 15, 37, 80, 300, 1000):
        for counts in ({}, {b: 10**6 for b in range(60)}):  # allocations without and with tolerant segments
            plan = jaccard_join.allocate(counts, 2000)
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**64, n, np.uint64))
                drop, add = rng.integers(0, n // 19 + 1, 2)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**64, add, np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert len(np.intersect1d(jaccard_join.signatures(a, plan), jaccard_join.signatures(b, plan)))


def test_jaccard_odd_rows(spark):
    got = jaccard_join.components(docs_of(spark, odd_rows(random.Random(9)), True)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by[6]["component_id"] == 5 and by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[None]["component_id"] is None
    assert jaccard_join.components(docs_of(spark, [])).collect() == []


# --- 4 ----------------------------------------------------------------------------------------


def test_raking_meets_targets():
    cells = {(s, g, t): float(m) for m, (s, g, t) in enumerate([(s, g, t) for s in "abc" for g in "xy" for t in "01"], 5)}
    targets = [{"a": 0.4, "b": 0.35, "c": 0.25}, {"x": 0.55, "y": 0.45}, {"0": 0.5, "1": 0.5}]
    chance = mixing.rake(cells, targets, 0.5)
    total = sum(chance[k] * m for k, m in cells.items())
    assert total == pytest.approx(0.5 * sum(cells.values()), rel=1e-6) and max(chance.values()) <= 1
    for d, target in enumerate(targets):
        for name, share in target.items():
            assert sum(chance[k] * m for k, m in cells.items() if k[d] == name) / total == pytest.approx(share, rel=1e-6)


def test_raking_takes_all_of_what_is_short():
    chance = mixing.rake({("a",): 90.0, ("b",): 10.0}, [{"a": 0.5, "b": 0.5}], 0.5)
    assert chance[("b",)] == 1.0 and chance[("a",)] <= 1


def test_raking_tells_if_it_does_not_settle(monkeypatch):
    cells = {("a", "x"): 5.0, ("a", "y"): 40.0, ("b", "x"): 30.0, ("b", "y"): 25.0}
    wants = [{"a": 0.5, "b": 0.5}, {"x": 0.5, "y": 0.5}]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixing.rake(cells, wants)
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    with pytest.warns(RuntimeWarning, match="did not settle"):
        mixing.rake(cells, wants)


def test_many_cells_are_raked_in_time():
    rng = random.Random(3)
    cells = {(f"s{i}", rng.choice("abcd"), rng.choice("01234567")): rng.randrange(1, 999) for i in range(100_000)}
    shares = []
    for d in range(3):
        names = sorted({k[d] for k in cells})
        shares.append({n: 1 / len(names) for n in names})
    began = time.time()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        mixing.rake(cells, shares)
    assert time.time() - began < 20


def raked(cells, wants, keep):
    """Brute force: cell by cell, one dimension after the other."""
    total = sum(cells.values())
    chance = dict.fromkeys(cells, keep)
    for _ in range(3000):
        for d, want in enumerate(wants):
            for name, share in want.items():
                own = [k for k in cells if k[d] == name]
                have = sum(chance[k] * cells[k] for k in own) / total
                for k in own:
                    chance[k] = min(1.0, chance[k] * keep * share / have)
    return chance


def many_sources(spark, n=100):
    rng = random.Random(16)
    rows = [(i, prose(rng, 20 + i % 13), f"s{i % n}", ("en", "de", None)[i % 7 % 3]) for i in range(6 * n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_mixing_matches_brute_force_with_every_source_a_category(spark, monkeypatch):
    rows, df = many_sources(spark)
    got = {r["doc_id"]: r for r in mixing.weigh(df).collect()}
    cells = {}
    for doc_id, text, source, lang in rows:
        key = (source, lang or mixing.NONE, str(got[doc_id]["topic"]))
        cells[key] = cells.get(key, 0.0) + len(text.split())
    wants = []
    for d in range(3):
        mass = {}
        for k, v in cells.items():
            mass[k[d]] = mass.get(k[d], 0.0) + v
        wants.append({k: v**0.5 / sum(x**0.5 for x in mass.values()) for k, v in mass.items()})
    want = raked(cells, wants, mixing.KEEP)
    for doc_id, _, source, lang in rows:
        assert got[doc_id]["probability"] == pytest.approx(want[source, lang or mixing.NONE, str(got[doc_id]["topic"])], abs=1e-6)
    assert len({r["topic"] for r in got.values()}) > 2
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 10)  # the same by joins
    for r in mixing.weigh(df).collect():
        assert r["probability"] == pytest.approx(got[r["doc_id"]]["probability"], abs=1e-6) and r["topic"] == got[r["doc_id"]]["topic"]


def test_mixing_targets(spark, monkeypatch):
    rows, df = many_sources(spark)
    targets = {"source": {f"s{i}": 1 / 99 for i in range(99)}}  # s99 is tempered
    for cells in (mixing.DRIVER_CELLS, 10):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
        got = mixing.weigh(df, targets).collect()
        assert min(r["probability"] for r in got) > 0
        drawn = {s: sum(r["probability"] * r["n_tokens"] for r in got if r["source"] == s) for s in ("s3", "s42", "s99")}
        assert drawn["s3"] == pytest.approx(drawn["s42"], rel=0.02) and drawn["s99"] > 0
        for bad in ({"source": {"nowhere": 1.0}}, {"lang": {}}, {"lang": {"en": -1.0}}):
            with pytest.raises(ValueError):
                mixing.weigh(df, bad)


def test_mixing_rows(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40), f"s{i % 3}" if i % 7 else None, "en" if i % 2 else None, i) for i in range(300)] + [(900, None, "s0", "en", 1), (901, "", None, None, 1), (901, "", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic long")
    got = mixing.weigh(df).collect()
    assert len(got) == len(rows) and {r["n_tokens"] for r in got if r["doc_id"] < 900} == {40}
    assert all(0 < r["probability"] <= 1 and 0 <= r["topic"] < mixing.TOPICS for r in got)
    asked = sum(r["probability"] * r["n_tokens"] for r in got)
    drawn = sum(r["n_tokens"] for r in got if r["kept"])
    assert asked == pytest.approx(0.5 * 40 * 300, rel=0.02) and abs(drawn - asked) < 0.2 * asked
    assert mixing.weigh(df.limit(0)).collect() == []


# --- 5 ----------------------------------------------------------------------------------------


def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(25 if c else 90):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.08 * rng.random()).astype(np.float32).tolist(), c % 3))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(4)] + [(1100, rows[0][1], None), (1101, None, 1), (1102, [0.0] * 16, 1), (1103, [float("nan")] * 16, 1), (1104, [None] * 16, 1), (1105, [], 1), (1106, [1e30] * 16, 1), (1107, [2e30] * 16, 1), (1108, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cid", "2 as codes")
    got = rows_of(embed_dedup.near_duplicates(df.unionByName(df.where("vec_id = 1000"))), "vec_id")
    usable = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: g for i, _, g in rows}
    links = {i: {j for j in usable if j != i and label[i] == label[j] and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= 0.98} for i in usable}
    assert len(got) == len(rows)
    found, there = sum(got[i]["n_links"] for i in usable), sum(map(len, links.values()))
    assert there > 3000 and all(got[i]["n_links"] <= len(links[i]) for i in usable) and found >= 0.99 * there
    for i in usable:
        seen, stack = {i}, [i]
        while stack:
            for y in links[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)
    for i in (1100, 1101, 1102, 1103, 1104, 1105):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_doubles_and_labels_of_any_type(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((6, 16))
    rows = [(10 * i + j, (base[i] + 0.01 * j * rng.standard_normal(16)).tolist(), f"label {i % 2}") for i in range(6) for j in range(3)] + [(99, base[0].tolist(), None), (100, [1e-300] * 16, "label 0")]
    for kind in ("double", "float"):
        got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")).collect()}
        assert all(got[10 * i + j] == (10 * i, 2) for i in range(6) for j in range(3)) and got[99] == (99, 0)


# --- 6 ----------------------------------------------------------------------------------------


def test_url_rules_and_hosts(spark):
    rows = [
        (1, "https://WWW.Example.com/en/x?q#f", "allow", "www.example.com/en/"), (2, "https://blog.example.com/en/", "block", "example.com/en/"), (3, "http://a.com/", "allow", "com/"),
        (4, "http://a.com", "allow", None), (5, "http://x.net/fr/1", "block", "net/fr/"), (6, "http://net/es/", "block", "net/es/"), (7, "http://xnet/es/", "allow", None), (8, None, "allow", None),
        (9, "no scheme", "allow", None), (10, "http://x.net/fr", "allow", None), (11, "http://x.net?/fr/", "allow", None), (11, "http://x.net?/fr/", "allow", None), (None, "a://b#c://d/", "allow", None),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "'h' as host", "1 as n")
    none = spark.createDataFrame([(3, None)], "page_id long, good int")
    got = url_filter.judge(pages, none).collect()
    assert len(got) == len(rows)
    for page, url, verdict, rule in rows:
        r = next(x for x in got if x["page_id"] == page)
        host = (url.split("://", 1)[1] if url and "://" in url else "")
        assert (r["verdict"], r["rule"], r["host"]) == (verdict, rule, re.match(r"[^/?#]*", host)[0].lower())
    assert url_filter.judge(pages.limit(0), none).collect() == []


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.site.org/{i}") for i in range(80)] + [(1000 + i, f"http://h{i}.fine.org/") for i in range(100)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(80)] + [(1000 + i, 1) for i in range(100)] + [(3, 1)], "page_id long, good int")
    got = {(r["host"], r["verdict"]) for r in url_filter.judge(pages, labels).collect() if r["page_id"] < 1000}
    assert got == {("bad.site.org", "block"), ("good.site.org", "allow")}


def test_prior_strength_is_that_of_the_data(spark):
    rng = np.random.default_rng(3)

    def estimated(strong):
        rows = []
        for p in range(4):
            mean = 0.2 + 0.2 * p
            for u in range(300):
                n = int(rng.integers(5, 60))
                rows.append((f"p{p}", n, int(rng.binomial(n, rng.beta(strong * mean, strong * (1 - mean))))))
        return url_filter.strength(spark.createDataFrame(rows, "parent string, n long, g long"), "parent", "s").first()["s"]

    for strong in (3.0, 10.0, 60.0):
        assert estimated(strong) == pytest.approx(strong, rel=0.35)
    few = spark.createDataFrame([("p", 5, 2)], "parent string, n long, g long")
    assert url_filter.strength(few, "parent", "s").first()["s"] == url_filter.STRENGTH == url_filter.strength(few.limit(0), "parent", "s").first()["s"]


def test_upper_bound_is_the_beta_quantile(spark):
    rng = np.random.default_rng(5)
    cases = [(20, 3, 0.5, 8.0), (200, 150, 0.7, 30.0), (5, 5, 0.6, 8.0), (0, 0, 0.4, 8.0), (1000, 20, 0.3, 50.0)]
    df = spark.createDataFrame(cases, "n int, g int, prior double, s double").select("*", url_filter.upper_bound(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, ("n", "g", "prior", "s"))).alias("u"))
    for r in df.collect():
        draws = rng.beta(r["g"] + r["s"] * r["prior"], r["n"] - r["g"] + r["s"] * (1 - r["prior"]), 400_000)
        assert r["u"] == pytest.approx(np.quantile(draws, 0.95), abs=0.006)


def test_ports_and_repeated_pages(spark):
    pages = [(1, "http://a.org:80/"), (1, "http://a.org:80/"), (2, "http://a.org/"), (3, "http://10.0.0.1/x")]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(1, 0)] * 3, "page_id long, good int"), ()).collect()
    assert sorted((r["page_id"], r["host"]) for r in got) == [(1, "a.org:80"), (1, "a.org:80"), (2, "a.org"), (3, "10.0.0.1")]


# --- 7 ----------------------------------------------------------------------------------------


def test_unlabelled_domains_take_their_suffix(spark):
    pages = [(i, f"http://h{i % 40}.bad{i % 40}.biz/{i}") for i in range(400)] + [(i, f"http://g{i % 40}.fine{i % 40}.org/{i}") for i in range(400, 800)]
    pages += [(i, f"http://www.bad.co.uk/{i}") for i in range(800, 900)] + [(i, f"http://www.x{i}.co.uk/{i}") for i in range(900, 1200)]
    labels = [(i, 0 if i < 400 or 800 <= i < 900 else 1) for i in range(1200)]
    pages += [(2000, "http://new.unseen.biz/"), (2001, "http://new.unseen.org/"), (2002, "http://new.unseen.co.uk/"), (2003, "http://new.unseen.zz/"), (2004, "http://sub.bad.co.uk/")]
    got = rows_of(url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good long"), ()), "page_id")
    assert [got[i]["verdict"] for i in range(2000, 2005)] == ["block", "allow", "allow", "allow", "block"]
    bad = spark.createDataFrame([(i, 0) for i in range(400)], "page_id long, good long")
    got = rows_of(url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), bad, ()), "page_id")
    assert got[2003]["verdict"] == "block"


def test_quality_is_learned_and_scored(spark):
    rng = random.Random(10)
    junk = lambda: " ".join(w.upper() + "!!" for w in prose(rng, 30).split())
    rows = [(i, junk() if i % 5 == 0 else prose(rng, 40 + i % 60)) for i in range(600)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(400)] + [(3, 1), (5, None), (None, 1)], "doc_id long, quality int")
    docs = docs_of(spark, [*rows, *[(1000 + (i or 0), t) for i, t in odd_rows(rng)]], True)
    got = rows_of(quality_mil.score(docs, quality_mil.fit(docs, labels)))
    assert np.mean([got[i]["predicted"] == (i % 5 != 0) for i in range(400, 600)]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    empty = docs_of(spark, [])
    assert quality_mil.fit(empty, labels) is None and quality_mil.score(empty, None).collect() == []
    assert {r["predicted"] for r in quality_mil.score(docs_of(spark, [(1, None)]), None).collect()} == {1}


def test_quality_matches_training_on_the_whole_sample(spark, monkeypatch):
    monkeypatch.setattr(quality_mil, "EPOCHS", 3)
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.choice([5, 70, 400]))) for i in range(60)] + [(60, prose(rng, 9000)), (61, None), (62, "")]
    labels = [(i, i % 2) for i in range(63)]
    docs = docs_of(spark, [*rows, (3, "zzz repeated id"), (3, rows[3][1])])
    least = {**dict(rows), 3: min("zzz repeated id", rows[3][1])}
    model = quality_mil.train([quality_mil.features(least[i]).astype(np.float64) for i in range(63)], np.array([i % 2 for i in range(63)], float))
    got = quality_mil.score(docs, quality_mil.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        x = quality_mil.features(r["text"]).astype(np.float64)
        assert r["score"] == pytest.approx(model.forward(x, np.array([0]))[-1][0], abs=1e-6)
    assert len(quality_mil.features(rows[60][1])) == -(-9000 // quality_mil.PASSAGE_WORDS)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((n, quality_mil.N_FEATURES)) for n in (1, 3, 5)]
    model = quality_mil.Model(np.zeros(quality_mil.N_FEATURES), np.ones(quality_mil.N_FEATURES), rng)
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, starts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradients(x, starts, y)
    for name in "wbvuacd":
        flat = model.p[name].reshape(-1)
        for i in (0, len(flat) // 2):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-6 == pytest.approx(grads[name].reshape(-1)[i], abs=1e-5)


# --- 8 ----------------------------------------------------------------------------------------


def best_chain(pos, ref):
    """Quadratic chaining: the best score."""
    order = sorted(range(len(pos)), key=lambda i: (pos[i], ref[i]))
    f = {}
    for i in order:
        f[i] = 1 + max([0, *(f[j] - substring_dedup.GAP_COST * (pos[i] - pos[j] + ref[i] - ref[j]) for j in f if pos[j] < pos[i] and ref[j] < ref[i])])
    return max(f.values())


def test_chains_match_quadratic_chaining():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        pos, ref = rng.integers(0, 120, n), rng.integers(0, 120, n)
        found = substring_dedup.chains(pos, ref)
        assert len({i for c in found for i in c}) == sum(map(len, found))
        score = lambda c: len(c) - substring_dedup.GAP_COST * (pos[c[-1]] - pos[c[0]] + ref[c[-1]] - ref[c[0]])  # noqa: E731, B023
        for c in found:
            assert all(pos[a] < pos[b] and ref[a] < ref[b] for a, b in zip(c, c[1:], strict=False))
        if found:
            assert max(map(score, found)) == pytest.approx(best_chain(pos.tolist(), ref.tolist()))


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 20))], [rng.randrange(4) for _ in range(rng.randrange(20))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substring_dedup.common(a, b) == t[-1][-1]


def test_passages_with_edits_every_few_words(spark):
    rng = random.Random(11)
    fresh = iter(f"w{i}" for i in range(10**6))
    take = lambda n: [next(fresh) for _ in range(n)]
    rows, alike = [], {}
    for k in range(120):
        a = take(rng.randrange(50, 61) if k >= 40 else 55)
        if k < 40:
            b = [next(fresh) if i % 8 == 7 else w for i, w in enumerate(a)]
        else:
            edits = set(rng.sample(range(1, len(a) - 1), round(len(a) * rng.uniform(0.1, 0.19))))
            b = [next(fresh) if i in edits else w for i, w in enumerate(a)]
        alike[k] = substring_dedup.common(a, b) / len(a)
        rows += [(2 * k, " ".join(take(40) + a + take(40))), (2 * k + 1, " ".join(take(40) + b + take(40)))]
    found = {(r["doc_id"], r["other_doc"]) for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect()}
    hit = [(2 * k, 2 * k + 1) in found and (2 * k + 1, 2 * k) in found for k in range(120)]
    print("every 8th word", sum(hit[:40]), "of 40; 0.8 to 0.9 alike", sum(hit[40:]), "of 80, least", min(alike.values()))
    assert sum(hit[:40]) == 40
    assert sum(hit[40:]) >= 72


def test_windows_share_a_minimiser():
    rng = np.random.default_rng(1)
    for n in (1, 5, 16, 17, 60):
        x = rng.integers(0, 2**64, n, np.uint64)
        at = substring_dedup.minimisers(x, 16)
        assert all(((at >= s) & (at < s + 16)).any() for s in range(max(1, n - 15)))


def test_keys_name_blocks_that_hold_them():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 2**64, n, np.uint64) for n in (3, 50, 383, 384, 385, 479, 512, 640, 641, 769, 3000)]
    fps = np.arange(len(texts), dtype=np.int64) << 40
    keys, holders = substring_dedup.keys_of(texts, fps)
    for text, fp in zip(texts, fps.tolist(), strict=True):
        own = holders >> substring_dedup.BLOCK_BITS << substring_dedup.BLOCK_BITS == fp
        blocks = list(range(0, max(1, len(text) - substring_dedup.BLOCK + substring_dedup.STRIDE), substring_dedup.STRIDE))
        for key, block in zip(keys[own].tolist(), (holders[own] - fp).tolist(), strict=True):
            part = text[blocks[block] : blocks[block] + substring_dedup.BLOCK]
            assert key in set(substring_dedup.keys_of([part], np.array([0]))[0].tolist()) or key & 1  # a long key depends on its neighbours
    run = np.full(60, 7, np.uint64)
    assert len(np.intersect1d(substring_dedup.keys_of([run], np.array([0]))[0], substring_dedup.keys_of([run[:55]], np.array([0]))[0])) >= 1


def test_pairs_need_two_short_keys_or_a_long_one():
    bits = substring_dedup.BLOCK_BITS
    h = lambda c, k=0: (c << bits) | k
    a = np.array([h(1), h(1), h(1), h(1, 4), h(1, 5), h(2)])
    b = np.array([h(2), h(3), h(4), h(5, 7), h(5, 8), h(5)])
    weight = np.array([1, 2, 1, 1, 1, 1])
    order = np.lexsort((b, a))
    assert substring_dedup.worthy(a[order], b[order], weight[order]).tolist() == [False, True, False, True, True, False]


def long_repeats(rows, width=50):
    """Brute force: the words of each text that stand in a run of `width` words that another text holds."""
    own = {t.lower(): (d, t.lower().split()) for d, t in rows if t}
    grams = {}
    for _, w in own.values():
        for g in {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}:
            grams[g] = grams.get(g, 0) + 1
    return {d: {i + k for i in range(len(w) - width + 1) if grams[tuple(w[i : i + width])] > 1 for k in range(width)} for d, w in own.values()}


def test_passages_of_popular_fragments_meet_their_own_partners(spark):
    for seed in range(3):
        rng = random.Random(seed)
        u = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]  # noqa: E731, B023
        passage = u(100)
        rows = [(1, " ".join(u(300) + passage + u(80))), (2, " ".join(u(60) + passage + u(900)))]
        for i in range(208):
            at = rng.randrange(77)
            rows.append((3 + i, " ".join(u(60) + passage[at : at + 24] + u(60))))
        got = {(r["doc_id"], r["start_word"], r["end_word"], r["other_doc"]) for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect()}
        assert got == {(1, 300, 400, 2), (2, 60, 160, 1)}


def test_pairs_meet_in_portions(spark, monkeypatch):
    """Pairs go through the shuffle a portion at a time, each once, with the same passages; tables of words and links are written compressed."""
    rng = random.Random(17)
    words = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    parts = [words(70) for _ in range(12)]
    rows = [(i, " ".join(words(80) + parts[i % 12] + words(300) + parts[(i * 5 + 1) % 12] + words(80))) for i in range(48)]
    plain = lambda: sorted(tuple(r) for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect())
    whole = plain()
    told, stored = [], substring_dedup.stored

    def watched(df, label, **options):
        out = stored(df, label, **options)
        told.append((label, out.count(), {".zstd." in f for f in out.inputFiles()}))
        return out

    monkeypatch.setattr(substring_dedup, "stored", watched)
    monkeypatch.setattr(substring_dedup, "PORTION", 20)
    monkeypatch.setattr(substring_dedup, "PORTIONS", 5)
    assert plain() == whole and len({r[0] for r in whole}) == 48
    pairs = [n for label, n, _ in told if label in ("linked-blocks", "open-blocks")]
    assert pairs[0] > 100 and sum(label == "compared" for label, _, _ in told) == sum(max(1, min(5, -(-n // 20))) for n in pairs)
    compared = [n for label, n, _ in told if label == "compared"][:5]
    assert max(compared) < 0.5 * sum(compared)
    assert all(zstd == {True} for label, n, zstd in told if label in ("links", "all-links", "blocks") and n)


def test_fuzzy_passages_of_popular_keys_meet(spark):
    """Every key of a passage stands in other texts too, before and after its two holders by hash: in a few, or in many."""
    rng = random.Random(5)
    u = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passages = [u(72) for _ in range(12)]
    rows = []
    for k, a in enumerate(passages):
        b = [f"v{k}x{i}" if i % 8 == 7 else w for i, w in enumerate(a)]
        rows += [(2 * k, " ".join(u(40) + a + u(40))), (2 * k + 1, " ".join(u(40) + b + u(40)))]
    for i in range(9 * 45):
        parts = [a[8 * (i % 9) : 8 * (i % 9) + 7] + u(25) for k, a in enumerate(passages) if k % 2 or i < 9 * 8]
        rng.shuffle(parts)
        rows.append((1000 + i, " ".join(u(25) + sum(parts, []))))
    found = {(r["doc_id"], r["other_doc"]) for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect()}
    assert found == {pair for k in range(12) for pair in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k))}


def test_links_of_later_rounds():
    bits = substring_dedup.BLOCK_BITS
    group = np.array([1, 1, 1, 2, 2], np.uint64)
    holders = np.array([5, 6, 7, 5, 8], np.int64) << bits
    flags = np.array([0, 1, 0, 0, 0], np.uint8)
    told = lambda only: sorted((int(a) >> bits, int(b) >> bits, bool(o)) for part in substring_dedup.all_links(group, holders, flags, only) for a, b, o, _ in zip(*part, strict=True))
    assert told(False) == [(5, 6, True), (5, 7, False), (5, 8, False), (6, 7, True)]
    assert told(True) == [(5, 6, True), (6, 7, True)]
    spans = (np.array([3, 3, 4]), np.array([10, 0, 0]), np.array([20, 50, 5]))
    assert substring_dedup.covered(np.array([3, 3, 4, 4, 9]), np.array([15, 46, 0, 2, 0]), np.array([40, 51, 5, 7, 1]), spans).tolist() == [True, False, True, False, False]


def test_sieve_leaves_every_pair_with_a_passage():
    rng = np.random.default_rng(8)
    blocks = [rng.integers(0, 2**32, n, np.uint64).astype(np.uint32) for n in (200, 120, 300)]
    blocks[1][30:85] = blocks[0][100:155]
    blocks[1][33:85:6] += np.uint32(1)
    frame = pd.DataFrame({"holder": [7, 3, 9], "words": [b.tobytes() for b in blocks]})
    kept = substring_dedup.dense_pairs(pd.DataFrame({"a": [3, 3, 7], "b": [7, 9, 9]}), frame)
    assert list(zip(kept["a"], kept["b"], strict=True)) == [(3, 7)]
    assert substring_dedup.passages_of(blocks[1].astype(np.uint64), blocks[0].astype(np.uint64))


def test_groups_cover_every_open_place():
    """Blocks of a group, whole and in two parts: whatever passage covers an open place, one that does is told, and covered blocks meet no more."""
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 2**32, n, np.uint64).astype(np.uint32)
    line, other, bits = fresh(14), fresh(70), substring_dedup.BLOCK_BITS
    shared, blocks, partner = [fresh(40) for _ in range(10)], [], {}
    for k in range(60):  # all hold the line twice and another passage; around the first line, 20 have a partner
        around = np.concatenate([shared[k // 2][:20], line, shared[k // 2][20:]]) if k < 20 else np.concatenate([fresh(20), line, fresh(20)])
        blocks.append(np.concatenate([fresh(30), around, fresh(40), line, fresh(50), other, fresh(30)]))
        partner[k] = k ^ 1 if k < 20 else None
    width = substring_dedup.END_BITS
    spot = np.array([1 | 50 << 1 | 64 << (1 + width), 1 | 124 + 20 << 1 | 138 + 20 << (1 + width)], np.int32).tobytes()
    pdf = pd.DataFrame({"holder": [(k + 1) << bits for k in range(60)], "fp": [(k + 1) << bits for k in range(60)], "block": 0, "words": [b.tobytes() for b in blocks], "places": spot})
    for side in (np.zeros(60, int), np.arange(60) % 2):
        got = substring_dedup.group_passages(pdf.assign(side=side))
        told = {(r.fp >> bits, r.ref >> bits) for r in got.itertuples() if r.start <= 50 and r.end >= 64 and r.rstart <= 50 and r.rend >= 64}
        assert told == {(k + 1, k + 2) for k in range(0, 20, 2)}
        assert len(got) <= 2 * 20  # the passage that all hold stands around no open place: its 1,770 pairs are not told


def test_equal_groups_are_one_and_list_no_pairs():
    bits = 2
    holders = np.arange(1, 41, dtype=np.int64) << substring_dedup.BLOCK_BITS
    parts = np.full(40, 1 | 7 << 1 | 12 << (1 + substring_dedup.END_BITS), np.int64)
    rows = pd.DataFrame({"kind": "twos", "range": 0, "x": [np.full(40, k, np.uint64).tobytes() for k in (5, 6, 7)], "y": holders.tobytes(), "z": parts.tobytes()})
    found = pd.concat(substring_dedup._two_linked(bits)(iter([rows])))
    assert set(found["kind"]) == {"groups"}
    tasks = pd.concat(substring_dedup._group_parts(iter([found.sort_values("range")])))
    assert tasks["holder"].tolist() == holders.tolist() and tasks["task"].nunique() == 1


def test_exact_repeats_match_brute_force(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    take = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [take(rng.randrange(50, 400)) for _ in range(30)] + [["the"] * 70, ["ha"] * 50]
    rows = []
    for i in range(200):
        text = take(rng.randrange(5, 700))
        for _ in range(rng.randrange(3)):
            part = rng.choice(shared)
            at = rng.randrange(len(part) - 49)
            text += part[at : at + rng.randrange(50, 400)] + take(rng.randrange(40))
        rows.append((i, " ".join(text)))
    need = {d: w for d, w in long_repeats(rows).items() if w}
    covered = {}
    for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    lost = sum(len(w - covered.get(d, set())) for d, w in need.items())
    print("documents with exact repeats", len(need), "words", sum(map(len, need.values())), "lost", lost)
    assert all(w & covered.get(d, set()) for d, w in need.items())
    assert lost <= 0.02 * sum(map(len, need.values()))


def test_repeated_passages(spark):
    rng = random.Random(12)
    unique = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = unique(80)
    fuzzy = passage.split()
    for i in (20, 41, 60):
        fuzzy[i] = "changed"
    copy = unique(120)
    rows = [(i, f"{unique(40 + i)} {passage} {unique(30)}") for i in range(20)] + [(50, f"{unique(70)} {' '.join(fuzzy)} {unique(10)}"), (60, unique(200)), (61, unique(20)), (62, passage[:200] + " " + unique(90))]
    rows += [(70, copy), (71, copy.upper()), (72, copy), (72, copy), (80, None), (81, ""), (None, passage)]
    got = substring_dedup.repeated_passages(docs_of(spark, rows, True)).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append(r)
    assert set(spans) == {*range(20), 50, 70, 71, 72}
    for i in range(20):
        assert any(r["start_word"] <= 40 + i and r["end_word"] >= 120 + i for r in spans[i])
    assert spans[50][0]["similarity"] == pytest.approx(77 / 80, abs=0.02)
    assert {(r["start_word"], r["end_word"]) for r in spans[71]} == {(0, 120)} and {r["other_doc"] for r in spans[70]} == {72}
    assert substring_dedup.repeated_passages(docs_of(spark, [])).collect() == []


# --- 9 ----------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["", "▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    lattice, rng = language_id.Lattice(pieces), np.random.default_rng(0)
    prob = rng.random((len(pieces), 2))

    def total(text, k):
        return 1.0 if not text else sum(prob[i, k] * total(text[len(p) :], k) for i, p in enumerate(pieces) if p and text.startswith(p)) + (0 if text[0] in "▁ab" else prob[0, k] * total(text[1:], k))

    words = ["a", "ab", "abba", "bab", "zab", "baab"]
    got = lattice.log_probabilities(words, prob)
    for w, row in zip(words, got, strict=True):
        assert np.exp(row) == pytest.approx([total("▁" + w, 0), total("▁" + w, 1)])
    uses = lattice.expected(["ab"], np.array([3.0]), prob[:, 0])
    ways = {("▁", "a", "b"): 0, ("▁", "ab"): 0, ("▁a", "b"): 0, ("▁ab",): 0}
    for way in ways:
        ways[way] = np.prod([prob[pieces.index(p), 0] for p in way])
    for p in pieces[1:]:
        assert uses[pieces.index(p)] == pytest.approx(3 * sum(v * way.count(p) for way, v in ways.items()) / sum(ways.values()))


def test_long_words_are_summed_like_short_ones():
    pieces = ["", "▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aabbaabb"]
    lattice, rng = language_id.Lattice(pieces), np.random.default_rng(1)
    prob = rng.random((len(pieces), 3)) / 10
    words = ["a", "abba", "zzz", "aabbaabbaabbz", "ab" * 16]
    short = lattice.log_probabilities(words, prob)
    for w, row in zip(words, short, strict=True):
        assert lattice.log_long(w, prob) == pytest.approx(row)
        assert lattice.expected_long(w, prob[:, 1]) == pytest.approx(lattice.expected([w], np.array([1.0]), prob[:, 1]))
    huge = lattice.log_long("ab" * 20_000, prob)  # several stretches, far below what a float holds unscaled
    assert np.isfinite(huge).all() and huge == pytest.approx(lattice.log_long("ab" * 10_000, prob) * 2, rel=1e-2)


def segmentations(word, pieces):
    """Brute force: every segmentation of a word as piece ids; a character that is no piece is piece 0."""
    if not word:
        yield []
        return
    known = set(pieces[1:])
    for n in range(1, len(word) + 1):
        if word[:n] in known or n == 1:
            own = pieces.index(word[:n]) if word[:n] in known else 0
            for rest in segmentations(word[n:], pieces):
                yield [own, *rest]


def test_no_piece_of_the_vocabulary_is_left_out():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=language_id.VOCABULARY)
    wanted = {p for p in (model.id_to_piece(i).lower() for i in range(model.get_piece_size())) if re.fullmatch(r"▁?[^\W\d_]*", p)}
    pieces = language_id.pieces_of(language_id.VOCABULARY)
    assert set(pieces[1:]) == wanted and max(map(len, pieces)) > 8
    lattice, prob = language_id.Lattice(pieces), np.random.default_rng(2).random((len(pieces), 2)) / 100
    long = next(p for p in pieces if len(p) > 12 and p[0] == "▁")[1:]
    for word in (long, "zz" + long):
        want = [np.log(sum(np.prod(prob[own, k]) for own in segmentations("▁" + word, pieces))) for k in range(2)]
        assert lattice.log_probabilities([word], prob)[0] == pytest.approx(want) and lattice.log_long(word, prob) == pytest.approx(want)


def test_fit_and_identify_match_brute_force(spark, monkeypatch):
    pieces = ["", "▁", "▁a", "a", "b", "c", "ab", "ba", "ca", "abc"]
    monkeypatch.setattr(language_id, "pieces_of", lambda path: pieces)
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abbz" if i % 2 else "accb") for _ in range(rng.randrange(1, 7))) for _ in range(8)), "x" if i % 2 else "y") for i in range(30)]
    df = spark.createDataFrame([*rows, (90, "½ ² ①", None), (91, "a½b", None), (92, "Ⅷ", "x")], "doc_id long, text string, lang string")
    langs, _, prob = language_id.fit(df)
    want = np.full((len(pieces), 2), 1 / len(pieces))
    for _ in range(language_id.ROUNDS):
        uses = np.full(want.shape, language_id.SMOOTHING)
        for _, text, lang in rows:
            k = langs.index(lang)
            for w in text.split():
                ways = [(np.prod(want[way, k]), way) for way in segmentations("▁" + w, pieces)]
                for p, way in ways:
                    np.add.at(uses[:, k], way, p / sum(q for q, _ in ways))
        want = uses / uses.sum(0)
    assert langs == ["x", "y"] and prob == pytest.approx(want)
    got = rows_of(language_id.identify(df, (langs, pieces, prob)))
    for doc_id, text, _ in rows:
        log = [sum(np.log(sum(np.prod(want[way, k]) for way in segmentations("▁" + w, pieces))) for w in text.split()) for k in (0, 1)]
        assert got[doc_id]["lang_pred"] == langs[int(np.argmax(log))]
        assert got[doc_id]["score"] == pytest.approx(1 / (1 + np.exp(min(log) - max(log))))
    assert [got[i]["lang_pred"] for i in (90, 92)] == ["und", "und"] and got[91]["lang_pred"] in langs
    assert language_id.words_of("a½b Ⅷ x²y ①") == ["a", "b", "x", "y"]


def test_languages_are_told_apart(spark):
    rng = random.Random(3)
    en, de = ["the", "with", "house", "thing", "over", "which"], ["der", "mit", "häuser", "straße", "über", "nicht"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(20)), "en" if i % 2 else "de") for i in range(200)]
    odd = [(1000, None, None), (1001, "", "en"), (1002, "123 !?", None), (1003, "x" * 5000, None), (1004, "漢字かな", None), (1000, None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = language_id.identify(df.withColumn("score", df.doc_id), language_id.fit(df.where("doc_id < 120"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(by[i]["lang_pred"] == rows[i][2] for i in range(120, 200))
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.fit(df.limit(0)) is None and language_id.identify(df.limit(0), None).collect() == []


# --- 10 ---------------------------------------------------------------------------------------


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    w = words_by_hand(text)
    hit, names = set(), set()
    for item, t in items:
        iw = words_by_hand(t)
        n = min(13, len(iw))
        for s in range(max(0, len(iw) - n + 1) if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[s : s + n]:
                    hit.update(range(i, i + n))
                    names.add(str(item))
    return len(w), len(hit), sorted(names)


def brute_near(texts, items):
    """Names of the nearby items of each text: by hand, over all places of all terms."""
    words = [words_by_hand(t) for t in texts]
    count = {}
    for w in words:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = [set() for _ in texts]
    for item, t in items:
        rare = sorted(set(words_by_hand(t)), key=lambda x: (count.get(x, 0), x.encode()))[: decontaminate.NEAR_TERMS]
        if item is None or len(rare) < decontaminate.NEAR_TERMS:
            continue
        for i, w in enumerate(words):
            at = {x: [k for k, y in enumerate(w) if y == x] for x in rare}
            if any(all(any(abs(p - q) <= decontaminate.NEAR_SLOP for q in at[x]) for x in rare[1:]) for p in at[rare[0]]):
                out[i].add(str(item))
    return [sorted(x) for x in out]


@pytest.mark.parametrize(("block", "index"), [(decontaminate.BLOCK_CHARS, decontaminate.INDEX_CHARS), (300, decontaminate.INDEX_CHARS), (100, 400)])
def test_decontamination_matches_brute_force(spark, monkeypatch, block, index):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", index)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 150)
    rng = random.Random(13)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 12, 5, 1, 30, 25])] + [(7, None), (8, ""), (9, "the " * 20), (10, "Über-straße 12 été")]
    rows = [(i, " ".join([prose(rng, rng.randrange(20)), " ".join(words_by_hand(rng.choice(items)[1])[rng.randrange(6) :]).upper(), "the, " * rng.randrange(16), prose(rng, 9)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "über-STRASSE Über-straße 12 été"), (102, "the"), (103, "the " * 13)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rid")
    got = decontaminate.match(docs_of(spark, rows, True), benchmark).collect()
    nears = brute_near([t for _, t in rows], items)
    want = sorted((i, *brute_hits(t, items), near) for (i, t), near in zip(rows, nears, strict=True))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), sorted(r["near"])) for r in got) == want and any(nears)
    assert decontaminate.match(docs_of(spark, []), benchmark).collect() == []
    assert {r["n_hit"] for r in decontaminate.match(docs_of(spark, rows), benchmark.limit(0)).collect()} == {0}


def test_items_close_together(spark):
    item = "zebra yellow xylophone whiskey victor umbrella tango sierra romeo quebec papa oscar november mike"
    near = "some words umbrella more whiskey here zebra and yellow then xylophone at tango last victor end sierra romeo quebec papa oscar mike november"
    got = rows_of(decontaminate.match(docs_of(spark, [(1, near), (2, "nothing here")]), spark.createDataFrame([(5, item)], "item_id long, text string")))
    assert got[1]["near"] == ["5"] and got[1]["n_hit"] == 0 and got[2]["near"] == []


def test_items_split_over_documents_are_not_near(spark):
    item = "zebra yellow xylophone whiskey"
    rows = [(1, "zebra yellow"), (2, "xylophone whiskey"), (3, "whiskey and yellow zebra"), (4, "xylophone"), (5, "x xylophone whiskey yellow zebra")]
    got = rows_of(decontaminate.match(docs_of(spark, rows).coalesce(1), spark.createDataFrame([(5, item), (None, "xylophone whiskey yellow")], "item_id long, text string")))
    assert {i for i, r in got.items() if r["near"] == ["5"]} == {5}
    assert got[5]["n_hit"] == 3 and got[5]["items"] == []  # hit by the item without id, which has no name
