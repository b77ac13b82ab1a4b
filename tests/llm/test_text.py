"""Packing, byte-level BPE, toxicity, licences and pages against libraries and plain loops."""

import hashlib
import html as html_lib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockweave.llm import byte_bpe, html_extract, license_scan, packing, shingles, toxicity
from blockweave.runtime import table

PIECES = ["a", "b", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "'ll", "don't", "é", "É", "中文", "​", "\x1c", "\x85", "\xa0", "　", "1", "23", "٣", "!", "?!", ".'s", "😀"]
PIECES += ["the", "ing", "A", "ʼ", "é", "“", "…", "<|endoftext|>", "Σ", "ΑΣ", "İ", "ﬁ", "K", "\x00"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "x" * 30_000, "word " * 9000]


def thue_morse(size=2048):
    """Two words that collide under any polynomial hash modulo a power of two."""
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    return [a, b]


def test_words_with_equal_polynomials_have_different_hashes():
    for size in (32, 64, 1024, 2048):
        words = thue_morse(size)
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        runs = shingles.words_of(data, np.array([0, len(data)]))
        for table_number in (0, 1):
            assert len(set(runs.hashes(table_number).tolist())) == 2


def test_words_do_not_depend_on_what_stands_around_them():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdéZ", k=rng.choice([1, 2, 5, 63, 64, 65, 200]))) for _ in range(300)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    whole = shingles.words_of(data, np.array([0, len(data)]))
    for word, h, g in zip(words, whole.hashes(0).tolist(), whole.heads(5).tolist(), strict=True):
        alone = np.frombuffer(word.lower().replace("É", "é").encode(), np.uint8)
        own = shingles.words_of(alone, np.array([0, len(alone)]))
        assert own.hashes(0).tolist() == [h] and own.heads(5).tolist() == [g] and (g != 0) == (len(alone) >= 5)


def test_a_wrong_entry_of_the_memo_is_noticed():
    """As if two words had one hash: the second is still encoded as the library does."""
    own, library = packing._Tokenizer(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))

    def ids(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return np.frombuffer(own.encode(data, np.array([0, len(data)]))[0], "<u4").tolist()

    ids("horses run")
    own.letters[:6] = np.frombuffer(b"houses", np.uint8)
    for text in ("horses run", "houses run"):
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


# -- packing ---------------------------------------------------------------------------------


def test_tokenizer_matches_the_library(odd_texts):
    own, library = packing._Tokenizer(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    odd_texts = odd_texts + ["".join(f"{w}<|endoftext|>{w.upper()}" for w in ("a", " b", "\u0301")), "<|startoftext|", "<|STARTOFTEXT|>", "|endoftext|>", *thue_morse()]
    got = []
    for _, _, data, offsets in shingles.slices(pa.array(odd_texts)):
        got += own.encode(data, offsets)
    for text, ids in zip(odd_texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text[:80])


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 3)
    assert [bins.place(n) for n in (6, 5, 4, 5, 3)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 9, 3, 4)] == [0, 1, 2, 0, 3]  # bin 1 closes for the nine, not bin 0, which still takes the three
    rng = random.Random(2)
    items, bins, load = [rng.randint(1, 99) for _ in range(3000)], packing.BestFit(100, 50), {}
    for n in items:
        at, offset = bins.place(n)
        assert offset == load.get(at, 0) and offset + n <= 100
        load[at] = offset + n


def naive_best_fit(items, capacity, most):
    """How full the bin of each item is before it, and the bins made, by looking through all open bins for every item."""
    is_open, out, made = [], [], 0
    for n in items:
        fitting = [x for x in is_open if x + n <= capacity]
        if not fitting:
            if len(is_open) == most:
                is_open.remove(max(is_open))
            made += 1
        load = max(fitting, default=0)
        if fitting:
            is_open.remove(load)
        if load + n < capacity:
            is_open.append(load + n)
        out.append(load)
    return out, made


def test_best_fit_matches_a_plain_one():
    rng = random.Random(4)
    for most in (1, 3, 40):
        for _ in range(30):
            items, bins = [rng.randint(1, 50) for _ in range(300)], packing.BestFit(50, most)
            loads, made = naive_best_fit(items, 50, most)
            assert [bins.place(n)[1] for n in items] == loads and bins.made == made and bins.open <= most


def test_packing_is_whole_gapless_and_tight(spark, small_dir):
    docs = table(spark, small_dir, "documents").unionByName(spark.createDataFrame([(10**6, None, "x", "y", 0), (10**6 + 1, "", "x", "y", 0)], table(spark, small_dir, "documents").schema))
    out = packing.pack_documents(docs, path("word_bpe_49k.json")).collect()
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    total = 0
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in parts] == [
            (i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(ids), 2048))
        ]
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * -(-total // 2048) + 1
    again = packing.pack_documents(docs.repartition(3), path("word_bpe_49k.json"))
    assert again.select("sequence_id").distinct().count() <= len(sequences) + 2


def test_packing_takes_odd_tables(spark):
    shape = "doc_id long, text string, bin int, row int"
    assert packing.pack_documents(spark.createDataFrame([], shape), path("word_bpe_49k.json")).count() == 0
    rows = [(1, "same words", 1, 1)] * 3 + [(None, None, 1, 1), (2, "word " * 5000, 1, 1)]
    out = packing.pack_documents(spark.createDataFrame(rows, shape), path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in out) == [(0, 0, 1), (1, 0, 3), (1, 0, 3), (1, 0, 3), (2, 0, 2048), (2, 1, 2048), (2, 2, 905)]


# -- byte-level BPE ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(path("byte_bpe_50k.tiktoken"))


def test_bpe_matches_the_library(ranks, odd_texts):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.Encoder(ranks)
    for text in odd_texts:
        ids = own.ids(text)
        assert ids == library.encode_ordinary(text), ascii(text[:80])
        assert own.decode(ids) == text.encode()


def test_prefixes_appends_and_edits(ranks):
    rng, vocabulary = random.Random(4), byte_bpe.Vocabulary(ranks)
    for _ in range(100):
        data = bytes(rng.choice(b"abcthe ingr\xc3\xa9") for _ in range(rng.randint(1, 300)))
        grown = byte_bpe.PrefixTable(vocabulary, data[:50])
        grown.append(data[50:])
        for n in (1, len(data) // 2, len(data)):
            assert [vocabulary.bytes_of[i] for i in grown.ids(n)] == vocabulary.merged(data[:n])
        start = rng.randint(0, len(data))
        stop = rng.randint(start, len(data))
        grown.edit(start, stop, b"zxe")
        assert grown.last == byte_bpe.PrefixTable(vocabulary, data[:start] + b"zxe" + data[stop:]).last
    long = byte_bpe.PrefixTable(vocabulary, b"the thing and the other " * 2000)
    assert long.edit(10, 11, b"q") < 1000  # only what is near is redone


def test_bpe_query_rows(spark, ranks):
    rows = [(1, None, 0), (2, "", 0), (3, "Hello  world\n", 0), (3, "Hello  world\n", 0), (None, "x" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in byte_bpe.round_trip(df, path("byte_bpe_50k.tiktoken")).collect()))) == sorted(map(repr, want))
    table_rows = byte_bpe.encode_table(df, path("byte_bpe_50k.tiktoken")).collect()
    assert sorted(len(r["ids"]) for r in table_rows) == sorted(w[1] for w in want)
    assert byte_bpe.round_trip(df.limit(0), path("byte_bpe_50k.tiktoken")).count() == 0


# -- toxicity --------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert (rows.predicted == rows.toxic).mean() > 0.97
    ranks, ones = rows.score.rank(), rows.toxic.sum()
    area = (ranks[rows.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(rows) - ones))
    assert area > 0.97
    assert (rows[rows.toxic == 0].predicted == 1).mean() < 0.01


def test_features_see_what_they_name():
    texts = ["you idiot", "an idiot is far far far far far from here you", "id1ot", "YOU ARE!!", "a plain text", ""]
    (_, _, data, offsets), = shingles.slices(pa.array(texts))
    x = toxicity.features(data, offsets, toxicity.Lexicon([]))
    at = toxicity.FEATURES.index
    assert x[0, at("near_fixed")] == 1 and x[1, at("near_fixed")] == 0
    assert x[2, at("hidden")] > 0 and x[2, at("mixed")] > 0 and x[0, at("hidden")] == 0
    assert x[3, at("all_caps")] == 1 and x[3, at("exclaims")] > 0
    assert not x[5].any() and not x[4, : at("near_fixed")].any()


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(3)
    raw = np.sort(rng.normal(size=200))
    y = (rng.random(200) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    _, heights = toxicity.isotonic(raw, y)
    assert (np.diff(heights) > 0).all()
    # the max-min formula of isotonic regression
    best = [max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(heights, 9))


def test_toxicity_takes_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (None, "x", 3), (4, "y" * 200_000, 3)], "doc_id long, text string, _score int").withColumns({"_SCORE_": F.lit("s"), "Fold": F.lit(1), "LABEL": F.lit(2)})
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, empty).collect()
    assert len(got) == 5 and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    one = spark.createDataFrame([(2, 1, 1), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, one)
    assert model.trees is None and model.share in (0.0, 1.0)
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, empty))
    assert kept.columns == docs.columns and kept.count() == 5
    assert toxicity.score_documents(docs.limit(0), one).count() == 0


# -- licences ----------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_alignment_matches_the_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(60):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(1, 25))], np.uint64)
        b = np.array([rng.randrange(6) for _ in range(rng.randint(1, 25))], np.uint64)
        assert len(license_scan.align(a, b, 0, 60)) == lcs(a.tolist(), b.tolist())


def test_findings_have_coverage_and_spans(spark):
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "at no charge").replace("without limitation", "")
    filler = "Some words é come first here. "
    rows = [(1, filler + "Released under the MIT License." + filler), (2, filler * 3 + changed + " and more"), (3, filler), (4, None), (5, ""), (6, "Released under terms of a license"), (7, filler + "RELEASED, under (the) mit\nlicense!")]
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {1, 2, 7}
    text = rows[0][1]
    assert text[found[1]["span_start"] : found[1]["span_end"]] == "Released under the MIT License" and found[1]["coverage"] == 1.0
    span = rows[1][1][found[2]["span_start"] : found[2]["span_end"]]
    assert found[2]["license"] == "MIT" and 0.9 < found[2]["coverage"] < 1 and span.startswith("Permission is") and span.endswith("OTHER DEALINGS IN THE SOFTWARE")
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scans_match_every_shift_of_every_template(spark):
    """Against alignments of each template at each place of the text, without an index."""
    rng = random.Random(13)
    templates = {f"t{k}": " ".join(f"w{k}x{i}" for i in range(rng.randint(4, 30))) for k in range(5)}
    index, rows = license_scan.Index(templates), []
    for n in range(60):
        words: list[str] = []
        for _ in range(rng.randrange(3)):
            part = templates[f"t{rng.randrange(5)}"].split()
            for _ in range(rng.randrange(3)):  # some words go, others come
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = [f"n{rng.randrange(50)}"] * rng.randrange(2)
            words += [f"f{rng.randrange(50)}" for _ in range(rng.randrange(40))] + part
        rows.append((n, " ".join(words + [f"f{rng.randrange(50)}" for _ in range(rng.randrange(30))])))
    got: dict = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["license"], []).append(r["matched"])
    for n, text in rows:
        h, want = license_scan.words_of(text), {}
        for name, template in index.templates.items():
            if len(h):
                band = license_scan.BAND + len(template) // 10
                best = max(len(license_scan.align(template, h, shift, band)) for shift in range(-len(template), len(h)))
                if best >= license_scan.COVERAGE * len(template):
                    want[name] = best
        assert {name: max(m) for name, m in got.get(n, {}).items()} == want


def test_scans_take_odd_tables(spark):
    text = "Released under the MIT License."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "word " * 100_000 + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"License": F.lit("x"), "COVERAGE": F.lit(0), "matched": F.lit("y")})
    found = license_scan.scan(df).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in found) == [(0, "MIT-notice"), (1, "MIT-notice"), (1, "MIT-notice"), (4, "MIT-notice")]
    table_of = spark.createDataFrame([("own", "all rights are kept by us"), ("empty", "one two three")], "name string, text string")
    assert [r["license"] for r in license_scan.scan(spark.createDataFrame([(1, "here All Rights are kept by us.")], "doc_id long, text string"), table_of).collect()] == ["own"]
    assert license_scan.scan(df, {}).count() == 0


def test_many_findings_in_one_text(spark):
    text = "Released under the MIT License. Licensed under CC BY-NC 4.0. " * 4000
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert {r["license"]: r["count"] for r in found.groupBy("license").count().collect()} == {"MIT-notice": 4000, "CC-BY-NC-4.0-notice": 4000}
    with pytest.raises(ValueError):
        license_scan.Index({"short": "two words"})


def test_every_template_is_found_in_itself():
    index = license_scan.Index()
    for name, text in license_scan.TEMPLATES.items():
        h = license_scan.words_of("before it " + text + " behind it")
        g = license_scan.grams(h)
        found = index.findings(h, g, index.hits(g))
        assert name in [f.license for f in found], name


def test_licenses_are_whole(spark):
    ends = {"MIT": "DEALINGS IN THE SOFTWARE", "ISC": "PERFORMANCE OF THIS SOFTWARE", "Apache-2.0": "limitations under the License", "GPL-3.0-or-later": "www.gnu.org/licenses", "BSD-2-Clause": "POSSIBILITY OF SUCH DAMAGE", "BSD-3-Clause": "POSSIBILITY OF SUCH DAMAGE"}
    texts = [f"Before it. {license_scan.TEMPLATES[name]} Behind it." for name in ends]
    mit = license_scan.TEMPLATES["MIT"]
    cut = mit[: mit.index("IN NO EVENT")]
    texts += [cut, cut + "The holders answer for all that goes wrong with what they give away, at any time."]
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r["doc_id"]: (r["license"], r["coverage"], texts[r["doc_id"]][r["span_start"] : r["span_end"]]) for r in found}
    assert len(found) == len(spans) == len(texts)
    for i, (name, end) in enumerate(ends.items()):
        assert spans[i][:2] == (name, 1.0) and spans[i][2].endswith(end)
    assert spans[6][0] == spans[7][0] == "MIT-beginning"  # the rest is missing or another


# -- pages --------------------------------------------------------------------------------------


def test_articles_are_read_whole(spark, small_dir):
    import re

    got = {r["page_id"]: r for r in html_extract.extract(table(spark, small_dir, "pages")).collect()}
    for r in table(spark, small_dir, "pages").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        body = re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", body)
        want = " ".join(html_lib.unescape(re.sub(r"</?b>", "", body)).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_link_lists_that_differ_are_found_by_their_shape(spark):
    """Pages without an article: menus of other links and lengths on each page go by the template table alone."""
    rows, want = [], {}
    for i in range(40):
        links = "".join(f'<a href="/{i}/{k}">place {i} {k}</a>' for k in range(3 + i % 4))
        text = f"Story {i} goes on here <a href='/x'>with a link</a> for a while and ends"
        rows.append((i, f"http://h{i % 2}.org/{i}", f'<body><div class="places">{links}</div><div class="story"><h1>Head {i}</h1><p>{text}</p></div><section><ul><li><a>to {i}</a><li><a>more {i}</a></ul></section></body>'))
        want[i] = f"Head {i} Story {i} goes on here with a link for a while and ends"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    without = {r["page_id"]: r["text"] for r in html_extract.extract(pages, least=10**9, many=10**9).collect()}
    assert got == want and all("place" in t and "more" in t for t in without.values())


def test_nothing_but_boilerplate_goes():
    page = (
        '<main><h1>Title</h1><p>Lead.</p><article><div class="share-price">Share price fell</div><p>By <math><mi>x</mi></math> and <object>a figure</object>'
        '<noscript>seen without scripts</noscript> <span aria-hidden="true">*</span></p><div class="related widget social">Kept</div><svg><text>label</text></svg>'
        '<template>no</template><select><option>no</select></article></main><article>Second</article>'
    )
    assert html_extract.main_text(page) == "Title Lead. Share price fell By x and a figure seen without scripts * Kept label Second"


def test_pages_take_odd_tables(spark):
    body = "<html><body><nav>m</nav><article><p>" + "long text " * 100_000 + "</p></article></body></html>"
    rows = [(1, "http://a.b/c", body), (1, "http://a.b/c", body), (None, None, None), (2, "", "<p>x"), (3, "http://a.b/d", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"Host": F.lit("h"), "HASH": F.lit(1), "text": F.lit("t"), "digest": F.lit("d")})
    for broadcast in (1 << 20, 0):
        got = sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in html_extract.extract(df, broadcast=broadcast).collect())
        assert got == [(0, "", 0), (1, "long text", 999_999), (1, "long text", 999_999), (2, "x", 1), (3, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_markup_is_forgiven():
    page = (
        '<html><head><title>t</title></head><body><header>Top</header><div class="cookie-notice">We use</div><main><article class="post"><header><h1>T</h1></header>'
        "<p>a<b>b</b> c&nbsp;&lt;d&#233;<p>e<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><aside>no</aside><!-- no --><div id=\"comments\"><p>bad</p></div>"
        '<script>if(a<b){"</p>"}</script><form>f</form><div hidden>h</div></article></main><footer>z'
    )
    assert html_extract.main_text(page) == "T ab c <dé e x y 1 2 h"
    assert html_extract.main_text("") == "" and html_extract.main_text("just text") == "just text" and html_extract.main_text("<p>a</div></p>b") == "a b"
    assert html_extract.main_text("<nav>m</nav><div>one</div><div>two</div>") == "one two"


def test_site_templates_go_and_quoted_passages_stay(spark):
    quote = "<p>A passage that all pages quote.</p>"
    rows = [(i, f"https://h.example/{i}", f"<body><div><i>Logo of the site</i></div><div>Text {i}.</div></body>") for i in range(20)]
    rows += [(100 + i, f"https://k.example/{i}", f"<body><div><b>Site {i % 2}</b></div><article>{quote}<p>Own {i}</p><div>Follow us</div></article></body>") for i in range(20)]
    rows += [(200, "https://l.example/", "<div><i>Logo of the site</i></div>"), (201, None, None), (202, None, ""), (201, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    for broadcast in (1000, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, broadcast=broadcast).collect()}
        assert got[3] == "Text 3." and got[103] == "A passage that all pages quote. Own 3" and got[200] == "Logo of the site" and got[201] == got[202] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_templates_of_large_hosts_and_lists_inside_articles_go(spark):
    advert, menu = "<div>Rotating advert</div>", "<ul><li>Home<li>About</ul>"
    rows = [(i, f"https://h.example/{i}", f"<body>{advert if i < 110 else ''}<b>Seen often</b><div>Text {i}.</div></body>" if i < 120 else f"<div>Text {i}.</div>") for i in range(600)]
    rows += [(1000 + i, f"https://k.example/{i}", f"<article>{menu}<table><tr><td>Site</table><figure>Logo</figure><p>Quoted</p><ul><li>Own {i}</ul></article>") for i in range(8)]
    rows += [(2000 + i, f"https://h.example/copy/{i}", "<article><div>One page, copied.</div></article>") for i in range(110)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for broadcast in (1000, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, broadcast=broadcast).collect()}
        assert len(got) == 718 and got[2000] == "One page, copied." and got[3] == "Seen often Text 3." and got[300] == "Text 300." and got[1003] == "Quoted Own 3"


def test_markup_is_read_at_any_size():
    assert html_extract.main_text("<article><div><select><option>no</div><p>One<object> yes</article>") == "One yes"
    many = " ".join(f'a{i}="<{i}>"' for i in range(300))
    assert html_extract.main_text(f"<p {many}>text</p><p {many} end") == html_extract.main_text(f"<p>text</p>&lt;p {html_lib.escape(many, quote=False)} end")
    assert html_extract.main_text("<i>" * 600 + '<span class="advert">no</span>yes') == "yes"
    deep = "<div>" * 150 + "<div>site</div>text"
    assert html_extract.main_text(deep, set(html_extract.subtree_hashes("<div>site</div>"))) == "text"


def test_hostile_tags_take_linear_time():
    import time

    began = time.monotonic()
    for page in ("<a \"'<a '\"" * 20_000, "<a '\"'<a \"" * 20_000, "<a " + '"" ' * 100_000 + "<a '" * 20_000, '<a "" "<a" ' * 30_000, "<p><li>" + "<b>" * 30_000 + "<hr>" * 30_000, "<svg>" * 30_000, "<select><option>" * 20_000):
        html_extract.main_text(page, {1})
        html_extract.subtree_hashes(page)
    assert time.monotonic() - began < 30


def test_hostile_markup_takes_linear_time():
    import time

    began = time.monotonic()
    for page in (
        "<div>" * 30_000 + "x", "<b>" * 50_000 + "<div>y" * 10_000, "<p><b>a" * 20_000, "<ul><li>a" * 10_000 + "</b>" * 20_000, "<" * 50_000, "<a " * 50_000, '<a x="' * 20_000,
        "<!--" * 50_000, "<!" * 50_000, "<a " * 50_000 + "'\">", "<script>" * 20_000, "</p" * 50_000, "<article>" * 3000 + "q",
    ):
        html_extract.main_text(page)
        html_extract.subtree_hashes(page)
    assert time.monotonic() - began < 30
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_extract.main_text("<p a=\"x>y\" b='<q>'>ok</p><img src=\"data:" + "z" * 200_000 + '">end') == "ok end"
