"""Vectors, pages, token files and helpers against brute force."""

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_rows import ODD
from tokenizers import Tokenizer

from refledger.llm import coder, components, html_main, token_file, topk
from refledger.llm.common import no_null_text, pieces, range_hashes, sifted, split_words
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- top k -----------------------------------------------------------------------------------------

def brute_topk(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows
          if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ok) if b != a and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS norm", "2 AS part", "3 AS qkey")


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [-1.0, 2.0]), (3, [1.0, 0.5]), (2, [1.0, 0.5]), (4, None),
            (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (100, []), (101, []), (150, [1.0, 2.0, 3.0]),
            (8, [0.001, -0.001]), (9, [5.0, 5.0]), (200, [0.0, 0.0])]
    got = topk.top_products(vectors(spark, rows))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(rows)
    assert topk.top_products(vectors(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_topk_prunes_and_stays_exact(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (base[i % 6] + spread * rng.normal(size=8)) * (1 + 4 * (i % 7 == 0))]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(1000, 1200)]
    got = topk.top_products(vectors(spark, rows))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(rows)


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    others = unit(rng.normal(size=(4000, 6)))
    for _ in range(30):
        q, cosine = unit(rng.normal(size=6)), float(rng.uniform(0.3, 0.99))
        keep = topk.within(q, cosine, others)
        assert keep[(others @ q) >= cosine].all()


# --- pages -----------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav>menu</nav><header>site</header><article><h1>A &amp; B</h1><p>one<br>two  three<p>four &lt;x&gt;"
     "<aside>side</aside><div class='comments'><p>nice!</p></div><script>var a='</p>';</script></article><footer>f</footer></body>",
     "A & B\none two three\nfour <x>"),
    ("", ""), (None, ""), ("<p>unclosed <b>bold", "unclosed bold"), ("plain &eacute; text & more", "plain é text & more"),
    ("<article></article>", ""), ("<div><div class=\"ad\">buy</div><p>body text</p><form>f <input></form></div>", "body text"),
    ("<main><p>a</p><!-- <p>no</p> --><style>p{}</style><ul><li>x<li>y</ul></main><p>outside</p>", "a\nx\ny"),
    ("< not a tag > <p>5 < 6</p>", "< not a tag >\n5 < 6"), ("<p>" * 3000 + "deep", "deep"),
    ("<div>" * 3000 + "deep", "deep"), ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_page_text(page, want):
    root = html_main.parse(page or "")
    html_main.marked(root)
    assert html_main.main_text(root, frozenset()) == want


def test_site_templates(spark):
    box = "<div class='x1'><span>Join our club</span></div>"
    rows = [(i, f"https://Site.example/p{i}", f"<body>{box}<div><p>text {i}</p><p>Often quoted.</p></div></body>" if i % 3 else
             f"<body>{box}<div><p>text {i}</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"http://two.example/{i}", f"<body>{box}<p>own {i}</p></body>") for i in range(2)]
    rows += [(200, None, f"<body>{box}</body>"), (201, "not a url", f"<body>{box}</body>"), (None, "http://x.example", None)]
    rows += [(300 + i, "http://art.example/", f"<article><p>Same line.</p>{box}<p>n {i}</p></article>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS marks")
    got = {r.page_id: r for r in html_main.extract(pages).collect()}
    assert got[1].text == "text 1" and got[3].text == "text 3"  # the quoted paragraph is on two thirds of the pages
    assert got[100].text == "Join our club\nown 0" and got[200].text == "Join our club" and got[None].text == ""
    assert got[302].text == "Same line.\nn 2" and got[302].n_chars == 14
    assert len(got) == len({r[0] for r in rows}) and html_main.extract(pages.filter("false")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    post, art = "<body><div class=post><p>Own text.</p></div></body>", "<article><div>Own part.</div></article>"
    rows = [(i, f"http://copies.example/{i}", post) for i in range(5)]
    rows += [(10 + i, f"http://art.example/{i}", art) for i in range(3)]
    rows += [(20 + i, f"http://menu.example/{i}", f"<body><nav>{i}</nav><div><p>Mirrored.</p></div></body>") for i in range(4)]
    # three distinct pages with a box, and copies of one of them
    box = "<div class='x1'>Join us</div>"
    rows += [(30 + i, f"http://box.example/{i}", f"<body>{box}<div><p>t {min(i, 2)}</p></div></body>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    assert {got[i] for i in range(5)} == {"Own text."} and {got[10 + i] for i in range(3)} == {"Own part."}
    assert {got[20 + i] for i in range(4)} == {"Mirrored."}
    assert [got[30 + i] for i in range(9)] == [f"t {min(i, 2)}" for i in range(9)]


def test_boxes_of_some_pages_of_a_large_host(spark):
    box = ["<div class='x1'>Latest posts</div>", "<div class='x2'>Your basket</div>", "<div class='x3'>Thread list</div>"]
    rows = [(i, f"http://big.example/{i}", f"<body>{box[i % 3]}<div><p>text {i}</p></div></body>") for i in range(90)]
    rows += [(100 + i, f"http://big.example/a{i}", f"<article><p>Quoted.</p><p>own {i}</p></article>") for i in range(30)]
    rows += [(200 + i, f"http://big.example/s{i}", f"<body><div>Said twice.</div><div><p>more {i}</p></div></body>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    assert all(got[i] == f"text {i}" for i in range(90))  # each box is on a quarter of the host's pages
    assert all(got[100 + i] == f"Quoted.\nown {i}" for i in range(30))  # texts of articles are kept
    assert got[201] == "Said twice.\nmore 1"


# --- token files -----------------------------------------------------------------------------------

def want_tokens(docs):
    tok = Tokenizer.from_file(TOKENIZER)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    out, at = [], 0
    for i, t in order:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 2048])
def test_token_file(odd_docs, block):
    got = token_file.token_digest(odd_docs, TOKENIZER, block=block)
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr) == want_tokens(ODD)


def test_token_file_of_many(make_docs, no_docs):
    docs = [(i * 3 % 101, f"text {i} " * (i % 9)) for i in range(101)]
    got = token_file.token_digest(make_docs(docs), TOKENIZER, block=16, parts=5)
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr) == want_tokens(docs)
    assert token_file.token_digest(no_docs, TOKENIZER).count() == 0


def test_pieces_encode_like_whole_texts():
    texts = ["a b", "  a", "a  b ", " x\ny", "\n\na\n b", "", "   ", "<|endoftext|> a", "tab\t x", "a\n", "é è\n\n\nz", "it's I'll 12 345",
             None, "a \nb", "\x1c a b", "x  y", "x 　y", "a\r\nb c", "\u0085 n", "don't  stop", "1,000 2.5 %", "日本 語"]
    ids, n = token_file.Tokens(TOKENIZER).batch(pa.array(texts))
    tok = Tokenizer.from_file(TOKENIZER)
    want = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


def test_coder_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, 500), np.zeros(3000, int), np.array([], int), np.array([65535]), (rng.zipf(1.4, 4000) % 50000),
              np.tile([5, 6, 7, 50256], 300), np.array([0, 1, 2, 3] * 7)]
    data = coder.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, coder.decode_blocks(data)))
    assert all(coder.encode_blocks([b])[0] == d for b, d in zip(blocks, data))  # a block depends on no other
    assert len(data[1]) < 200 and len(data[5]) < 700
    assert coder.encode_blocks([]) == [] and coder.decode_blocks([]) == []


def test_damaged_blocks_are_noticed():
    good = coder.encode_blocks([np.arange(300) * 7 % 5000])[0]
    for at in range(0, len(good), 37):
        bad = bytearray(good)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            coder.decode_blocks([bytes(bad)])
    with pytest.raises(ValueError):
        coder.decode_blocks([good[:-3]])
    with pytest.raises(ValueError):
        coder.encode_blocks([np.array([70000])])


# --- helpers ---------------------------------------------------------------------------------------

def test_words_of_slices():
    column = pa.array(["Ab c", "d\te", "", None, "x", "y z", "é É q", "end"] * 5)
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    for rows in (3, 5, 64):
        for part in pieces(batch, rows):
            data, bounds, counts = split_words(no_null_text(part["text"]))
            want = [(t or "").encode().lower().split() for t in part["text"].to_pylist()]
            assert [data[a:b].tobytes() for a, b in bounds] == [w for ws in want for w in ws]
            assert counts.tolist() == [len(ws) for ws in want]
    data, bounds, _ = split_words(no_null_text(pa.array(["ab ab ba a"])))
    h = range_hashes(data, bounds)
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_sifted_keeps_all_wanted(spark):
    wanted = spark.range(0, 5000, 7).withColumnRenamed("id", "w")
    kept = {r.id for r in sifted(spark.range(5000), F.col("id"), wanted, F.col("w")).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 800


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (2000, 3000), (5, 5), (None, 7), (4000, 1500), (1500, 4000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[3000] == 1000 and got[4000] == 1500 and len(got) == 306


def test_pipeline_takes_effect(spark, sf):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination",
                                           "mixing sources to target weights", "token-ID / binary output"]
    names, kept = docs.columns, []
    for i, (_, stage) in enumerate(pipe.STAGES[:4]):
        path = os.path.join(pipe.shared_folder(spark, "test"), str(i))
        out = stage(spark, docs, sf)
        assert out.columns == names
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert len(kept[0]) > len(kept[1]) >= len(kept[2]) > 0 and kept[3] <= kept[2]
    final = pipe.STAGES[4][1](spark, docs, sf)
    want = want_tokens([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in final.collect()), key=repr) == want
    assert sorted((tuple(r) for r in pipe.run(spark, sf).collect()), key=repr) == want
