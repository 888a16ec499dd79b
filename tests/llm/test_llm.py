"""Operators of sylva.llm against brute force, exact round trips and reference tokenizers."""

import hashlib
import os
import random
import re
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F
from sylva.llm import bpe, chat, html_text, media, mixing, ngram_join, quality, queries, token_count, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def frame(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], DOCS)


ODD = [None, "", " ", "\n\n", "a", "A a A", "é" * 40, "x " * 3000, "\u00a0 \u2003z", "one two three four five six seven\n" * 3, "one two three four five six seven\n" * 3]


# --- 1 ---


def test_url_parts_and_rules(spark):
    rules = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7")]
    urls = ["http://A.Example.com/en/76?x#y", "http://b.com/en/", "ftp://com/en/x", None, "no", "http://bad.org?q", "http://x.bad.org#f", "://", "http://notbad.org/", "http://excom/en/1", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.org",), ("bad.org",), (None,)], "key string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed, rules).collect()}
    assert [got[0][c] for c in ("host", "path", "rule", "verdict")] == ["a.example.com", "/en/76", "example.com/en/7", "allow"]
    assert [got[i]["verdict"] for i in range(1, 11)] == ["block", "block", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert got[3]["host"] == "" and got[3]["path"] == "" and got[10]["host"] == "b:" and got[10]["path"] == "//c/d"
    empty = url_filter.filter_urls(pages.limit(0), listed, rules)
    assert empty.count() == 0


def test_path_belongs_to_the_first_host(spark):
    urls = ["http://a.com?u=http://b.com/en/7", "http://a.com#x://b.com/en/7", "http://a.com/de/?u=http://b.com/en/7", "http://a.com", "http://a.com/", "a?b://c.com/en/1", "http://a.com\n?u=x://b/en/7", "http://a.com/en/" + "x" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("b.com",)], "key string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed, [url_filter.Rule("block", "com", "/en/")]).collect()}
    assert [got[i]["path"] for i in range(7)] == ["", "", "/de/", "", "/", "/en/1", ""] and len(got[7]["path"]) == 50_004
    assert [got[i]["verdict"] for i in range(8)] == ["allow"] * 5 + ["block", "allow", "block"]


def test_rows_equal_the_sql_for_odd_urls(spark):
    duckdb = pytest.importorskip("duckdb")
    urls = ["http://a.com?u=http://b.net/de/x", "https://h.org#x://y/es/1", "x://A.COM/en/7?q", "http://sub.example.com/en/7", "://example.net/de/8/a#f", "http://adult-x.example.com", "http://m.ADULT-x.example.com/q", "no host", "", None, "http://", "http:///en/", "a://b://c.com/en/", "http://a.com/\n/en/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    listed = spark.createDataFrame([(x,) for x in queries.LISTED], "key string")
    got = sorted(map(tuple, url_filter.filter_urls(pages, listed, queries.RULES).collect()))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    assert got == sorted(con.sql(queries.ORACLE_SQL["op1_url_filter"]).fetchall())
    assert got[0][2] == "" and got[1][1:3] == ("h.org", "") and got[5][4] == "block" and got[3][4] == "allow"


def test_cascade_of_odd_lists(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)] + [(None,)], "key string")
    marked = lambda listed: {r["key"] for r in url_filter.BloomCascade().fit(keys, listed).mark(keys.where("key is not null").withColumn("names", F.array("key")), "names", "hit").where("hit").collect()}
    assert marked(keys.limit(0)) == set()
    assert marked(keys) == {f"k{i}" for i in range(300)}
    assert marked(spark.createDataFrame([("else",), (None,), ("k3",)], "key string")) == {"k3"}
    with pytest.raises(RuntimeError):
        url_filter.BloomCascade(bits_per_key=0.5, max_levels=1).fit(keys, keys.limit(100))


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(5000)]
    bad = set(random.Random(3).sample(keys, 700))
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = spark.createDataFrame([(k,) for k in [*bad, "absent"]], "key string")
    c = url_filter.BloomCascade(bits_per_key=3.0, slice_bits=512, max_bytes=256).fit(universe, listed)
    assert len(c.passes) > 1 and max(map(len, c.passes)) > 2
    out = c.mark(universe.select("key", F.array("key").alias("names")), "names", "hit").collect()
    assert {r["key"] for r in out if r["hit"]} == bad


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_spam_host_is_listed(spark, sf):
    """In the tables only spam hosts have a hyphen in the registered name."""
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    pages = queries.op1_url_filter(spark, path).select("host", "listed").collect()
    spam = [r for r in pages if re.search(r"(^|\.)[^.]*-[^.]*\.example\.(com|net|org)$", r["host"])]
    assert spam and all(r["listed"] for r in spam) and sum(r["listed"] for r in pages) == len(spam)


# --- 2 ---


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min([x for x in (least.get(find(i)), ids[i]) if x is not None], default=None)
    return [(ids[i], len(sets[i]), least[find(i)] if sets[i] else ids[i]) for i in range(len(texts))]


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(40)]
    texts = []
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 6, 9, 20, 60, 200]))]
        if r.random() < 0.3:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        texts.append(w)
        for _ in range(r.choice([0, 0, 0, 1, 2, 12])):
            c = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                c[r.randrange(len(c))] = r.choice(vocab)
            if r.random() < 0.3:
                c = c[r.randrange(1 + len(c) // 6) :]
            texts.append(c)
    return [" ".join(x) for x in texts] + ODD


@pytest.mark.parametrize("params", [{"part": 3, "rounds": 0}, {"hot_rate": 1, "hot_count": 2, "rounds": 1}])
def test_join_equals_brute_force(spark, params):
    texts = corpus(4, 45)
    ids = list(range(100, 100 + len(texts)))
    ids[3], ids[-2] = None, ids[0]
    got = ngram_join.NgramJoin(**params).fit(frame(spark, texts, ids).withColumn("n", F.lit(1)).withColumn("cid", F.lit(1)))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_components(texts, ids), key=key)


def test_words_are_not_confused(spark):
    """Texts that collide under polynomial hashes modulo a power of two, words around the block size, NUL bytes."""
    flips = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    texts = [flips, flips.translate(str.maketrans("ab", "ba")), "a", "a\x00", "x" * 8, "x" * 9, "x" * 32, "x" * 33, "x" * 33 + "\x00", "x" * 40 + "y", "x" * 40 + "z", "X" * 33]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.NgramJoin().fit(frame(spark, texts)).collect()}
    assert got == {i: 7 if i == 11 else i for i in range(len(texts))}
    batch = ngram_join.Shingler()
    import pyarrow as pa

    column = pa.array([*ODD, *texts, "One two THREE four\x0bfive six", "é É ü"] * 2)
    for part in (column, column.slice(3, 9)):
        for values, at in batch.sets(part):
            for i, text in enumerate(part.to_pylist()):
                own = values[at[i] : at[i + 1]]
                assert len(own) == len(ngram_join.word_shingles(text or "", 5)) and (np.diff(own.astype(object)) > 0).all() and (own == batch(text)).all()


def test_frequent_signatures_and_long_lists(spark, monkeypatch):
    """A group of near copies longer than a list's chunks, frequent signatures salted, lists torn between batches."""
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    r = random.Random(12)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.choice([1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    for params in ({"hot_rate": 1, "hot_count": 2, "part": 4}, {"hot_rate": 1, "hot_count": 10**6, "rounds": 0}):
        got = ngram_join.NgramJoin(**params).fit(frame(spark, texts)).collect()
        assert sorted(map(tuple, got)) == sorted(brute_components(texts, list(range(60))))


def test_join_of_nothing(spark):
    assert ngram_join.NgramJoin().fit(frame(spark, [])).count() == 0


def test_linked_sets_share_a_signature():
    t, rng = Fraction(4, 5), np.random.default_rng(1)
    for share in (0.0, 0.15, 0.4):
        lays = {b: ngram_join.layout(b, share, t) for b in range(14)}
        for size in (1, 4, 5, 8, 9, 10, 17, 40, 127, 128, 160, 700):
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
                gone = rng.integers(0, max(1, size // 9) + 1)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 64, rng.integers(0, max(1, size // 9) + 1), dtype=np.uint64)]))
                if not len(b) or not ngram_join._overlaps(a, b, t):
                    continue
                every = np.sort(np.concatenate([ngram_join.signatures(a, lays[x], n, t, ngram_join.EMPTY) for x, n in ngram_join.laid_out(len(a), t)]))
                for hot in (ngram_join.EMPTY, every[::2]):
                    sa, sb = (set(np.concatenate([ngram_join.signatures(s, lays[x], n, t, hot) for x, n in ngram_join.laid_out(len(s), t)]).tolist()) for s in (a, b))
                    assert sa & sb


# --- 3 and 7 ---


def odd_strings(n, seed=1):
    r = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "🎉", "12", ".", "!!", "_", "\x00", "\x1c", "'s", "zz", "tion", "ka", "▁", "<0x41>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = P.path("piece_bpe_32k.model")
    pieces = token_count.read_pieces(path)
    low = min(s for _, s in pieces)
    vocab = [("<unk>", low), *[(f"<0x{i:02X}>", low * 100) for i in range(256)], *pieces]
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [t for t in odd_strings(400) if "<0x" not in t] + [t or "" for t in ODD]
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(frame(spark, texts), path).collect()}
    assert [got[i] for i in range(len(texts))] == [len(tok.encode(t).ids) for t in texts]
    odd = frame(spark, ODD).withColumns({"n_tokens": F.lit("x"), "score": F.lit(None).cast("string")})
    assert token_count.count_tokens(odd, path).count() == len(ODD) and token_count.count_tokens(odd.limit(0), path).count() == 0


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = odd_strings(600) + ODD + ["ab" * 4000 + "q" * 3000]
    rows = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, texts), path, P.PATTERN, ids=True).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == (t or "") and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_of_odd_tables(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    odd = frame(spark, ODD).withColumns({"n_tokens": F.lit("x"), "ids": F.lit(None).cast("string")})
    assert bpe.encode_documents(odd, path, P.PATTERN).count() == len(ODD) and bpe.encode_documents(odd.limit(0), path, P.PATTERN).count() == 0


def test_transducer_forgets_and_decoder_replaces():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    small, large = bpe.Transducer(ranks, max_states=20, max_pieces=5, max_pairs=10), bpe.Transducer(ranks)
    for t in odd_strings(200, 7):
        assert small.piece(t or "a") == large.piece(t or "a")
    d = bpe.Utf8Decoder({0: b"\xe2", 1: b"\x82\xac", 2: b"x", 3: b"\xff"})
    for ids in ([0, 1], [0, 2], [3, 0], [0], [2, 0, 0, 1]):
        assert "".join(d.stream(ids)) == b"".join(d.bytes_of[i] for i in ids).decode(errors="replace")


def test_bpe_of_many_new_words_takes_few_new_transitions():
    import tiktoken

    path, rng = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(5)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    parts = ["le", "ç", "tion", "eau", "è", "ai", "oi", "ment", "eux", "pa", "é", "que", "th", "er", "an", "ing", "sch", "ung", "ü", "ein"]
    new = list(dict.fromkeys(" " + "".join(rng.choices(parts, k=rng.randint(3, 6))) for _ in range(6000)))
    own, steps = bpe.Transducer(bpe.read_ranks(path)), []
    plain = own._step
    own._step = lambda state, byte: steps.append(byte) or plain(state, byte)
    assert [list(own.piece(w)) for w in new] == [enc.encode_ordinary(w) for w in new]
    assert len(steps) < 2.2 * len(new)
    # together, with caches that overflow within a batch
    codec = bpe.Codec(path, P.PATTERN)
    codec.transducer = bpe.Transducer(bpe.read_ranks(path), max_states=50, max_pieces=100, max_pairs=50)
    texts = ["".join(rng.choices(new, k=30)) for _ in range(60)] + ODD[1:] + odd_strings(50, 3)
    texts = [t or "" for t in texts]
    for _ in range(2):
        assert [list(ids) for ids in codec.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


# --- 4 ---


@pytest.mark.parametrize("params", [{}, {"max_broadcast": 0}])
def test_media_round_trip(spark, params):
    base = " ".join(f"word{i * i % 977}" for i in range(4000))
    texts = ODD + [base, base, base[2000:] + "x", base[:9000], "y" * 40000]
    got = media.media_digests(frame(spark, texts).withColumn("key", F.lit("k")).withColumn("digest", F.lit("k")), **params).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        wav = b"RIFF" + (len(p) + 36).to_bytes(4, "little") + b"WAVEfmt \x10\x00\x00\x00\x01\x00\x01\x00\x40\x1f\x00\x00\x40\x1f\x00\x00\x01\x00\x08\x00data" + len(p).to_bytes(4, "little") + p
        assert r["tail_crc32"] == zlib.crc32(p[-32:]) and r["media_bytes"] == len(wav) and r["media_sha256"] == hashlib.sha256(wav).hexdigest()
        energy, crossings = sum((x - 128) ** 2 for x in p), sum((x < 128) != (y < 128) for x, y in zip(p, p[1:], strict=False))
        assert r["feature"] == f"n={len(p)};sum={sum(p)};energy={energy};crossings={crossings}"
    assert media.media_digests(frame(spark, []), **params).count() == 0
    store = media.store_media(frame(spark, texts), **params)
    assert store.where("kind = 1").count() > 3


def test_cuts_depend_on_content_only():
    r = random.Random(1)
    a, b = r.randbytes(60000), r.randbytes(777)
    x, y = {d for d, _ in media.chunks_of(a)}, {d for d, _ in media.chunks_of(b + a)}
    assert len(x & y) > 0.8 * len(x)
    for n in (0, 1, 511, 70000):
        assert b"".join(c for _, c in media.chunks_of(a[:n])) == a[:n]


# --- 5 ---


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "<", "<\\|", "a\\n<|", "", None, "<|image:1|>"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[((c or 0) + t) % len(nasty)], 1) for c in (1, 2, None) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    for c in (1, 2, None):
        mine = [(r[2], r[3] or "") for r in rows if r[0] == c]
        lost = "".join(t for role, t in mine if role == "assistant")
        assert got[c]["n_turns"] == 9 and got[c]["loss_chars"] == len(lost)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()
        escape = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
        assert got[c]["formatted_chars"] == sum(len(f"<|im_start|>{a}\n{escape(b)}<|im_end|>\n") for a, b in mine)
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = '[{"type":"text","text":"see <|"},{"type":"image","ref":"a.png","width":1000,"height":400},{"type":"audio","ref":"b","seconds":2},{"type":"image","ref":"c"}]'
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", "[not json")], "conv_id long, turn long, role string, text string")
    a, b = chat.format_conversations(df).orderBy("turn").collect()
    assert a["formatted"] == "<|im_start|>user\nsee <\\|<|image:1|><|audio:1|><|image:2|><|im_end|>\n"
    assert [(x["kind"], x["ref"], x["number"], x["tokens"]) for x in a["attachments"]] == [("image", "a.png", 1, 340), ("audio", "b", 1, 50), ("image", "c", 2, 170)]
    assert all(a["formatted"][x["offset"] :].startswith(f"<|{x['kind']}:{x['number']}|>") for x in a["attachments"])
    assert b["loss_end"] - b["loss_begin"] == len("[not json")


# --- 6 ---


def test_html():
    page = "<head><title>t</title></head><body><h1>Hi &amp; bye</h1><p>one <b>two</b>\n three<p>four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>q<td>22</table><p hidden>no</p><p style='display: none'>no</p><script>if (a < b) '<p>'</script><pre>a  b\n c</pre><!-- <p>no -->end"
    want = "Hi & bye\n\none two three\n\nfour\nfive\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName      | N\nlong name | 1\nq         | 22\n\na  b\n c\n\nend"
    assert html_text.page_text(page) == want
    assert html_text.page_text(None) == "" and html_text.page_text("") == "" and html_text.page_text("<") == "<" and html_text.page_text("a<b") == "a<b"
    assert html_text.page_text("<div>" * 20000 + "deep") == "deep"
    assert html_text.page_text("<table>before<tr><td>x</table>after") == "before\nx\n\nafter"


def slow_tree(page):
    """The tree builder by a walk over all open elements."""
    H = html_text
    root = H.Node("html")
    open_ = [root]

    def start(tag, attrs):
        if tag in ("html", "body") and any(n.tag == tag for n in open_[:3]):
            return
        changed = True
        while changed:
            changed = False
            for i in range(len(open_) - 1, 0, -1):
                if tag in H.ENDS.get(open_[i].tag, ()):
                    del open_[i:]
                    changed = True
                    break
                if open_[i].tag in H.SCOPE:
                    break
        if tag in ("td", "th") and open_[-1].tag != "tr":
            start("tr", {})
        if tag in ("tr", "tbody", "thead", "tfoot") and not any(n.tag == "table" for n in open_):
            start("table", {})
        node = H.Node(tag, attrs)
        open_[-1].children.append(node)
        if tag not in H.VOID:
            open_.append(node)

    for close, tag, text in re.findall(r"<(/?)(\w+)>|([^<]+)", page):
        if text:
            open_[-1].children.append(text)
        elif not close:
            start(tag, {})
        else:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            else:
                if tag in ("p", "br"):
                    start(tag, {})
                    if tag == "p":
                        open_.pop()
    return root


def plain(node):
    return node if isinstance(node, str) else (node.tag, [plain(c) for c in node.children])


def test_tree_equals_a_walk_over_open_elements():
    r = random.Random(5)
    tags = ["p", "div", "li", "ul", "ol", "td", "th", "tr", "table", "tbody", "thead", "caption", "b", "span", "h2", "dl", "dt", "dd", "option", "optgroup", "select", "br", "body", "section"]
    for _ in range(1500):
        page = "".join(r.choice([f"<{r.choice(tags)}>", f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f"w{i}"]) for i in range(r.choice([5, 20, 60])))
        joined = plain(html_text.parse(page))
        assert joined == plain(slow_tree(page)), page


@pytest.mark.parametrize("piece", ["<div>", "<b>", '<a "', '<a ="> " ', "<ul><li>", "<blockquote>x", "a<b>b</b> ", "<script></script ", "<", "<!-- ", "<p><span>", "<tr><td rowspan=65000 colspan=900>a"])
def test_html_time_is_linear(piece):
    import time

    seconds = []
    for n in (5_000, 40_000):
        began = time.process_time()
        html_text.page_text("<table>" * piece.startswith("<tr") + piece * n)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 * max(seconds[0], 0.05)  # eight times the length; a quadratic reader takes 64 times as long


def test_html_shows_what_a_browser_shows():
    for page, want in [
        ("<p title=it's>Hello, it's fine</p>", "Hello, it's fine"), ("<textarea>a\n b</textarea>x", "a\n b\nx"), ("<select><option>o1<option selected>o2</select>", "o1\no2"),
        ("<svg><title>n</title><text>hi</text></svg>", "hi"), ("<math><mi>x</mi></math>", "x"), ("<dialog>n</dialog><dialog open>y</dialog>", "y"), ("<input value=v><input type=hidden value=w><input type=submit value=Go>", "vGo"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    | c\n1 | 2 | 3"), ("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>", "r | x\n  | y"),
        ('<a x="1>2">t</a>', "t"), ('<a x="1>t</a>', "t"), ("<p>a</p></p>b", "a\n\nb"),
    ]:
        assert html_text.page_text(page) == want, page


def test_html_keeps_all_visible_words(spark):
    r = random.Random(2)
    for _ in range(300):
        tags = ["p", "div", "li", "ul", "td", "tr", "table", "b", "span", "h2", "pre", "ol", "blockquote"]
        page = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f" w{i} "]) for i in range(30))
        assert sorted(re.findall(r"w\d+", html_text.page_text(page))) == sorted(re.findall(r"w\d+", page))
    df = spark.createDataFrame([(1, "<p>a", 5), (None, None, 5)], "page_id long, html string, text int")
    assert sorted(r["text"] for r in html_text.extract_pages(df).collect()) == ["", "a"]
    assert html_text.extract_pages(df.limit(0)).count() == 0


# --- 8 ---


def test_toxicity_learns_words_and_prefixes(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts, y = [], []
    for i in range(1600):
        w = [word() for _ in range(r.choice([5, 30, 120]))]
        if i % 4 == 0:
            for _ in range(1 + len(w) // 25):
                w[r.randrange(len(w))] = r.choice(["vile", "zork", "xul" + word()])
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    net = toxicity.fit(texts[:1400], y[:1400], toxicity.Settings(steps=150))
    df = frame(spark, texts[1400:] + ODD, list(range(1400, 1600 + len(ODD)))).withColumn("score", F.lit(1))
    got = {x["doc_id"]: x for x in toxicity.score_documents(df, net).collect()}
    right = sum(got[i]["predicted"] == y[i] for i in range(1400, 1600))
    assert right > 180
    assert all(0 <= x["score"] <= 1 and x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert got[1600]["score"] == got[1601]["score"] and got[1600]["predicted"] == 0
    kept = toxicity.drop_toxic(df, net)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if not x["predicted"]}
    assert all(x["score"] == 0 for x in toxicity.score_documents(df, toxicity.fit(texts[:3], [0, 0, 0])).collect())


def test_scores_equal_a_plain_recurrence(spark):
    """Every window of every text, one step and one number at a time, in double precision."""
    import math

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice([1, 3, 5])))
    texts = [" ".join(["vile"] * (i % 3 == 0) + [word() for _ in range(r.choice([3, 20, 50, 130]))]) for i in range(60)]
    net = toxicity.fit(texts, [int(i % 3 == 0) for i in range(60)], toxicity.Settings(steps=20, word_buckets=64, gram_buckets=128))
    p, h = {k: v.astype(float) for k, v in net.p.items()}, net.s.hidden
    sig = lambda x: 1 / (1 + math.exp(-x))

    def logit(words):
        xs = [row.astype(float) for row in net.inputs(words)[0]] if words else [np.concatenate([net.inputs([b""])[0][0]]).astype(float)]
        states = {}
        for w, line in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            now = [0.0] * h
            for t in line:
                x = [sum(xs[t][i] * p[f"x{w}"][i][j] for i in range(len(xs[t]))) + p[f"b{w}"][j] for j in range(3 * h)]
                a = [sum(now[i] * p[f"h{w}"][i][j] for i in range(h)) for j in range(3 * h)]
                z, q = ([sig(x[k * h + j] + a[k * h + j]) for j in range(h)] for k in (0, 1))
                n = [math.tanh(x[2 * h + j] + q[j] * a[2 * h + j]) for j in range(h)]
                now = [n[j] + z[j] * (now[j] - n[j]) for j in range(h)]
                states[w, t] = now
        s = [states["f", t] + states["b", t] for t in range(len(xs))]
        e = [[math.tanh(sum(v[i] * p["attend"][i][j] for i in range(2 * h))) for j in range(h)] for v in s]
        a = [math.exp(sum(e[t][j] * p["query"][j] for j in range(h))) for t in range(len(s))]
        c = [sum(a[t] * s[t][i] for t in range(len(s))) / sum(a) for i in range(2 * h)]
        return sum(c[i] * p["out"][i] for i in range(2 * h)) + p["bias"][0]

    some = [texts[i] for i in (0, 1, 2, 7, 11)] + ["", None, "é! vile"]
    got = {x["doc_id"]: x["score"] for x in toxicity.score_documents(frame(spark, some), net).collect()}
    a, b = net.calibration
    for i, t in enumerate(some):
        w = toxicity.words_of(t)
        best = max(logit(w[j : j + net.s.window]) for j in toxicity.starts(len(w), net.s))
        assert abs(got[i] - sig(a * best + b)) < 1e-4


def test_gradients():
    s = toxicity.Settings(window=5, hidden=3, size=2, word_buckets=11, gram_buckets=13)
    net = toxicity.Network(s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, at, mask = rng.standard_normal((4, 4)), rng.integers(0, 4, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    goal = rng.standard_normal(3)

    def loss():
        return (net.forward({w: (x @ net.p[f"x{w}"] + net.p[f"b{w}"])[at] for w in "fb"}, mask) * goal).sum()

    tape = {}
    net.forward({w: (x @ net.p[f"x{w}"] + net.p[f"b{w}"])[at] for w in "fb"}, mask, tape)
    g, dx = net.backward(tape, goal, x, at)
    for v, d in [(net.p[k], g[k]) for k in g] + [(x, dx)]:
        for i in list(np.ndindex(v.shape))[:6]:
            was = v[i]
            v[i] = was + 1e-3
            up = loss()
            v[i] = was - 1e-3
            down = loss()
            v[i] = was
            assert abs((up - down) / 2e-3 - d[i]) < 2e-3


# --- 9 ---


def test_quality_features(spark):
    r = random.Random(5)
    texts = ODD + [" ".join(r.choice(["a", "b", "c#", "D|", "e\n"]) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["word " * 60, " ".join(f"w{i}" for i in range(80))]
    got = {x["doc_id"]: x for x in quality.score_documents(frame(spark, texts).withColumn("words", F.lit(1)).withColumn("n_words", F.lit(2))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = words(t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        cover = {j + k for j, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)} if len(w) < 500 else set(range(len(w)))
        lines = [x for x in t.split("\n") if words(x)]
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover)), t[:50]
        assert (x["n_symbols"], x["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert x["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (x["kept"] and x["base_failed"])
    kept = quality.apply_rules(frame(spark, texts))
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["kept"]} and kept.columns == frame(spark, texts).columns
    assert quality.score_documents(frame(spark, [])).count() == 0


def test_cascade_orders_by_rejection_per_cost(spark):
    order = quality.plan_cascade(frame(spark, ["a b c"] * 40))
    assert [e.value for e in order] == sorted((e.value for e in order), reverse=True) and order[0].rejected == 1


# --- 10 ---


def test_targets():
    assert mixing.target_sizes([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    t = mixing.target_sizes([100, 1, 50], [1, 2, 3])
    assert t[1] == 3 and abs(sum(t) - 151) < 1e-9 and abs(t[2] / t[0] - 3) < 1e-9
    assert mixing.target_sizes([], []) == [] and mixing.target_sizes([0, 5], [1, 1]) == [0, 5]


def test_flow_is_cheapest():
    # pattern 0 may serve both sources, pattern 1 only the second
    flow = mixing.min_cost_flow([[(10, 0), (10, 1)], [(5, 0), (5, 1)]], [[0, 1], [1]], [8, 7])
    assert flow == [[8, 2], [5]] and sum(mixing.min_cost_flow([[(4, 0), (4, 1), (4, 2)]], [[0]], [11])[0]) == 11


def test_mix(spark):
    r = random.Random(8)
    texts = [" ".join(["w"] * r.randint(0, 40)) for _ in range(400)] + [None, ""]
    sources = [r.choice(["b", "a", "a", "a", None, "é"]) for _ in texts]
    df = frame(spark, texts, None, sources).withColumn("size", F.lit(1)).withColumn("order", F.lit(1))
    runs = []
    for _ in range(2):
        taken, info = mixing.mix(df.repartition(3), F.array("source"))
        runs.append(sorted((x["doc_id"], x["size"], x["members"][0], x["taken"]) for x in taken.collect()) if False else {x["doc_id"]: (x["size"], x["members"][0], x["taken"]) for x in taken.collect()})
    assert runs[0] == runs[1] and len(runs[0]) == len(texts)
    for row in info.collect():
        mine = [x for x in runs[0].values() if x[1] == row["source"]]
        assert sum(x[0] for x in mine) == row["source_size"] and abs(sum(x[2] for x in mine) - row["target"]) <= 1
    assert all(0 <= x[2] <= 3 * x[0] for x in runs[0].values())
    assert [x["source"] for x in info.collect()] == ["a", "b", "é", None]
    assert mixing.mix(frame(spark, []), F.array("source"))[0].count() == 0


def test_mix_equals_a_walk_in_order(spark):
    """Taken words from a plain walk over each source's documents in the order of the seeded hash; equal rows share what is cut."""
    r = random.Random(3)
    texts = [" ".join(["w"] * r.randint(1, 30)) for _ in range(300)] + ["one two three four five"] * 90
    sources = [r.choice("abcd") for _ in range(300)] + ["b"] * 90
    ids = [*range(300), *[7] * 90]
    for repeats, weight in ((3, lambda i: 1.0 + i % 3), (2, lambda i: 1.0 + 9 * (i == 1))):
        taken, info = mixing.mix(frame(spark, texts, ids, sources), F.array("source"), weight, repeats)
        rows, targets = taken.collect(), {x["source"]: x["target"] for x in info.collect()}
        for name, target in targets.items():
            mine = sorted((x["order"] % (1 << 64), x["doc_id"], x["size"]) for x in rows if x["members"] == [name])
            whole = sum(n for _, _, n in mine)
            times, rest = divmod(round(target), whole)
            want = []
            for order, doc, n in mine:
                bit = min(n, max(0, rest))
                want.append((order, doc, n, times * n + bit))
                rest -= bit
            buckets = lambda v: v[0] >> 54  # noqa: E731  within a bucket the walk goes by the signed hash
            assert sum(x[3] for x in want) == sum(x["taken"] for x in rows if x["members"] == [name])
            got = sorted((x["order"] % (1 << 64), x["doc_id"], x["size"], x["taken"]) for x in rows if x["members"] == [name])
            assert [g for g, v in zip(got, sorted(want), strict=True) if g[0] >> 54 != buckets(v)] == []
            assert sorted(got) == sorted(want)


def test_toxicity_long_texts_stay_off_the_driver(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(9000)}" for _ in range(n)) for n in (30_000, 25_000, 12_000, 48, 49, 84, 85, 0)]
    s = toxicity.Settings(steps=2, bags=8, drawn=2)  # draws 32 windows
    seen, fit = [], toxicity.fit_parts
    monkeypatch.setattr(toxicity, "fit_parts", lambda parts, y, s: fit(seen.extend(parts) or seen, y, s))
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    net = toxicity.train(frame(spark, texts, ids), labels, s)
    assert [len(p) for p in seen] == [4, 4, 4, 1, 1, 1, 1, 1]
    for text, parts in zip(texts, seen, strict=True):
        w = toxicity.words_of(text)
        assert all(p in [w[j : j + s.window] for j in toxicity.starts(len(w), s)] for p in parts) if len(w) > 85 else parts == [w]
    scorer, small = toxicity.Scorer(net), toxicity.Scorer(net, block=8)
    small.voc.limit = 500
    for text, got, again in zip(texts, scorer.logits(texts), small.logits(texts), strict=True):
        w = toxicity.words_of(text)
        best = toxicity.Scorer(net).logits([" ".join(x.decode() for x in w[j : j + s.window]) for j in toxicity.starts(len(w), s)]).max()
        assert abs(got - best) < 1e-4 and abs(again - best) < 1e-4


def test_worker_keeps_one_value():
    from sylva.llm.common import per_process

    made = []
    for key in ("a", "a", "b", "a"):
        assert per_process(("test", key), lambda: made.append(key) or key) == key  # noqa: B023
    assert made == ["a", "b", "a"]
    assert [k for k in sys.modules["_sylva_process"].kept if k[0] == "test"] == [("test", "a")]


# --- pipeline ---


def test_long_documents_are_cut(spark):
    import corpus_pipeline

    r = random.Random(4)
    space = lambda: "".join(r.choice(" \t\n\r\x0b") for _ in range(r.choice([1, 1, 1, 3])))
    texts = [space() + "".join(f"é{i}{space()}" for i in range(20_000)) for _ in range(3)]
    docs = frame(spark, texts, None, ["x", "y", "z"])
    got = sorted(corpus_pipeline.mix_sources(spark, docs, "").collect(), key=lambda x: (x["doc_id"], -x["n_chars"]))
    cut = [x for x in got if x["text"] != texts[x["doc_id"]]]
    assert [len(words(x["text"])) for x in cut] == [10_000, 10_000]
    for x in cut:
        n = len(words(x["text"]))
        assert x["text"] == re.match(r"[\t-\r ]*(?:[^\t-\r ]+[\t-\r ]*){%d}" % n, texts[x["doc_id"]])[0] and x["n_chars"] == len(x["text"])
    taken, _ = mixing.mix(docs, F.array("source"))
    assert {x["doc_id"]: x["taken"] for x in taken.where("taken > 0").collect()} == {i: sum(len(words(x["text"])) for x in got if x["doc_id"] == i) for i in {x["doc_id"] for x in got}}


def test_rows_are_not_named_by_ids_alone(spark):
    import corpus_pipeline

    r = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(5))
    rows = [(1, a), (2, a + " end"), (2, b), (None, b), (None, c), (None, c + " end"), (None, d), (3, c + " x y"), (4, e), (4, e), (None, e), (5, a), (5, d + " z z z")]
    rows += [(6, ""), (None, " "), (None, None)]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    assert docs.where("doc_id is null").count() == 7
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    got = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=key)
    assert got == sorted([(1, a), (2, b), (3, c + " x y"), (4, e), (5, d + " z z z"), (6, ""), (None, " "), (None, None)], key=key)
    alone = corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null"), "").where("n_chars > 1").collect()
    assert sorted(words(x["text"])[0] for x in alone) == sorted(words(t)[0] for t in (b, c, d, e)) and all(x["doc_id"] is None for x in alone)
    rows = [(None, a), (None, b), (7, c), (7, d), (8, e)]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    mixed = sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.mix_sources(spark, docs, "").collect()), key=key)
    assert mixed == sorted(rows, key=key)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(80)) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", None, "", "short", "#$ " * 90]
    sources = [r.choice("xyz") for _ in texts]
    frame(spark, texts, None, sources).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, before = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            assert {x["doc_id"] for x in docs.collect()} == set(range(42))
        if name == "toxicity":  # row by row, by the scores of the same network
            net = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
            kept = {x["doc_id"] for x in before.collect() if toxicity.Scorer(net).scores([x["text"]])[0] < 0.5}
            assert {x["doc_id"] for x in docs.collect()} == kept
        if name == "near_duplicates":
            rows = sorted((x["doc_id"], x["text"]) for x in before.collect())
            least = {i: c for i, _, c in brute_components([t for _, t in rows], [i for i, _ in rows])}
            assert {x["doc_id"] for x in docs.collect()} == set(least.values())
        if name == "tokens":
            import tiktoken

            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            want = sorted((x["doc_id"], len(enc.encode_ordinary(x["text"]))) for x in before.collect())
            assert sorted((x["doc_id"], x["n_tokens"]) for x in docs.collect()) == want
        if name == "near_duplicates":
            ids = [x["doc_id"] for x in docs.collect()]
            assert len(ids) == len(set(ids)) and not ({40, 41} & set(ids) and {0, 1} <= {x["doc_id"] for x in before.collect()})
        if name == "mixing":
            sizes = {x["doc_id"]: len(words(x["text"])) for x in before.collect()}
            for x in docs.collect():
                assert len(words(x["text"])) <= sizes[x["doc_id"]] and x["n_chars"] == len(x["text"])
    assert docs.count() > 0 and set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    empty = tmp_path / "empty"
    frame(spark, []).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
