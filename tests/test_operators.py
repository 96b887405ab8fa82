"""Operators that SQL doesn't express, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing
from quillspark.graph import connected_components
from quillspark.operators import bpe, decoding, features, layout, reports, scoring
from quillspark.operators.engine import Engine
from quillspark.plans import registry
from quillspark.sources import readers


def test_connected_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, None), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in label:
        for u, v in edges:
            if u in label and v in label:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label


def test_hashes(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    def mix(h):
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * f % 2**64
        return h ^ h >> 33

    texts = ["", "a", "foobar", "ünï\x1f12", "x" * 50]
    h = hashing.fnv1a64(F.col("s"))
    rows = spark.createDataFrame([(s,) for s in texts], "s string").select("s", h.alias("h"), hashing.fmix64(h).alias("m")).collect()
    assert all(r.h % 2**64 == fnv(r.s) and r.m % 2**64 == mix(fnv(r.s)) for r in rows)
    assert fnv("foobar") == 0x85944171F73967E8


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_script():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(2))
        script = scoring.edit_script(a, b)
        assert sum(op != "match" for op, *_ in script) == plain_distance(a, b)
        assert "".join(x for _, x, _ in script) == a and "".join(y for *_, y in script) == b
    assert scoring.edit_script("a" * 5000, "b" * 5000) is None


def test_word_errors(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 9))), " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for i in range(40)]
    out = scoring.edit_counts(spark.createDataFrame(rows, "i int, ref string, got string"), "ref", "got").collect()
    assert all(r.word_errors == plain_distance(r.ref.split(), r.got.split()) and r.words == len(r.ref.split()) for r in out)


def test_line_matching_forgives_order():
    assert scoring.line_matched_errors(["abc def", "xyz"], ["xyz", "abc def"]) == (0, 10, 2)
    assert scoring.line_matched_errors(["abc def"], ["abc", "def"])[0] == 0
    assert scoring.line_matched_errors([], ["ab"]) == (2, 0, 0)


def test_features_of_simple_rasters():
    ring = np.zeros((10, 10), bool)
    ring[[0, -1]] = ring[:, [0, -1]] = True
    v = features.describe(ring, 8.0, 5.0)
    assert len(v) == features.DIMS and v[features.HOLES] == 1 and v[103] == 0
    assert abs(v[16:80].sum() - 1) < 1e-5 and abs(v[80:88].sum() - 1) < 1e-5
    assert features.describe(np.ones((4, 4), bool), 4, 0)[105:].tolist() == [-1, -1]


def test_decoder_prefers_the_lexicon():
    edges = [(i, i + 1, c, d, 0.0) for i, (a, b) in enumerate(zip("cat", "oet")) for c, d in ((a, 1.0), (b, 0.95)) if a != b or d == 1.0]
    plain = decoding.Decoder({}, {}).decode(edges)[0]
    assert plain == "oet"
    assert decoding.Decoder({}, {"cat": 1}).decode(edges)[0] == "cat"
    assert decoding.Decoder({}, {}).decode([]) == (None, None)


def test_case_anomalies():
    d = decoding.Decoder({}, {})
    assert [d.anomalies(s) for s in ("word", "Word", "WORD", "wOrd", "WOrd", "a-B")] == [0, 0, 0, 2, 1, 0]


def test_overrides_are_all_or_nothing(spark):
    params = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    good = spark.createDataFrame([("b", 5.0)], "name string, value double")
    assert {r.name: r.value for r in decoding.apply_overrides(params, good).collect()} == {"a": 1.0, "b": 5.0}
    with pytest.raises(ValueError):
        decoding.apply_overrides(params, spark.createDataFrame([("b", 5.0), ("z", 1.0)], "name string, value double"))


def test_engine_settings(spark):
    e = Engine(spark.createDataFrame([(1, "x", [0.0, 0.0]), (2, "y", [1.0, 1.0])], "proto_id long, class string, vec array<float>"))
    with pytest.raises(KeyError):
        e.set_param("none", 1)
    with pytest.raises(ValueError):
        e.set_feature_weights([-1.0])
    assert e.classifier_fallback()
    glyphs = spark.createDataFrame([(0, 0, 0, 7, [0.1, 0.0]), (0, 0, 0, 8, [0.9, 1.0])], "page int, line int, word int, q int, vec array<float>")
    assert e.recognize(glyphs).first().text == "xy"


def test_coordinate_descent():
    best, score = reports.coordinate_descent({"a": 0.0, "b": 0.0}, {"a": [1.0, 2.0], "b": [1.0]}, lambda many: [(s["a"] - 4) ** 2 + (s["b"] - 1) ** 2 for s in many])
    assert best == {"a": 4.0, "b": 1.0} and score == 0


def test_tsv_of_a_wrong_width_is_an_error(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# c\na\t1\nb\n")
    with pytest.raises(Exception, match="not 2 columns"):
        readers.read_tsv(spark, str(tmp_path), "k string, v int").collect()


def test_graymaps(spark, tmp_path):
    (tmp_path / "p.pgm").write_bytes(b"P5\n# made\n3 2\n255\n\x00\x01\x02\x0a\x20\xff")
    r = readers.parse_pgm(readers.list_files(spark, str(tmp_path), "*.pgm")).first()
    assert (r.stem, r.w, r.h, bytes(r.pixels)) == ("p", 3, 2, b"\x00\x01\x02\x0a\x20\xff")
    with pytest.raises(FileNotFoundError):
        readers.list_files(spark, str(tmp_path), "*.pbm")


def test_visual_rows(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 10, 0), (1, 2, 2, 12, 5), (1, 3, 20, 30, 0)], "page int, id long, y0 int, y1 int, x0 int")
    assert {r.id: r.row for r in layout.visual_rows(boxes, "page").collect()} == {1: 0, 2: 0, 3: 1}


def test_byte_pairs_merge_the_lowest_rank_first():
    alphabet = {c: i for i, c in enumerate(bpe.byte_symbols())}
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "d"), ("a", "a"), ("ab", "ab")]
    vocabulary = alphabet | {x + y: 256 + i for i, (x, y) in enumerate(merges)}
    encoder = bpe.BytePairEncoder(vocabulary, merges, {"<s>": 999, "<s>x": 998})

    def plain(word):
        parts = list(word)
        while found := [p for p in merges if p in list(zip(parts, parts[1:]))]:
            joined, i = [], 0
            while i < len(parts):
                pair = tuple(parts[i : i + 2]) == found[0]
                joined.append("".join(parts[i : i + 1 + pair]))
                i += 1 + pair
            parts = joined
        return [vocabulary[p] for p in parts]

    rng = random.Random(5)
    for _ in range(500):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        assert encoder.encode(word) == plain(word)
    assert encoder.encode("a<s>xb") == [vocabulary["a"], 998, vocabulary["b"]] and encoder.encode(None) == []


def test_byte_pairs_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    encoder, library = bpe.BytePairEncoder.from_json(content), Tokenizer.from_str(content)
    texts = ["internationalisation", "straße naïve", " the quick brown fox", "zzzzzzzzz" * 50, "<|endoftext|>"]
    rows = spark.createDataFrame(list(enumerate(texts + [None])), "id long, text string")
    got = {r.id: r.ids for r in bpe.encode_texts(rows, encoder, "id", "text").collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)} | {len(texts): []}


def test_automaton_size(spark):
    words = spark.createDataFrame([(w,) for w in ("tap", "taps", "top", "tops", None, "top")], "word string")
    assert tuple(decoding.automaton_size(words).first()) == (5, 5)


def test_decoding_and_shuffle_leave_nothing_out(spark):
    folder = "/root/testdata/sf0.001"
    texts = [r.text.lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect() if r.text]
    words = {w for t in texts for w in re.findall("[a-z]+", t)}
    assert max(map(len, words)) > 8
    decoded = registry.queries()["d01_d03_decode"](spark, folder).collect()
    assert sorted(r.word for r in decoded) == sorted(words) and all(r.text for r in decoded)
    ids = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    shuffled = [(r.h, r.doc_id) for r in registry.queries()["r24_seeded_shuffle"](spark, folder).collect()]
    assert sorted(i for _, i in shuffled) == sorted(ids) and shuffled == sorted(shuffled)


@pytest.mark.parametrize("rows", [4_000_000, 400, 20])
def test_containment_equals_a_plain_count(spark, monkeypatch, rows):
    """In one part, in parts of whole items, and with items over several parts."""
    from quillspark.operators import corpus

    monkeypatch.setattr(corpus, "INDEX_ROWS", rows)
    rng = random.Random(11)
    draw = lambda n: " ".join(rng.choices("abcd", k=n))
    docs = [(i, draw(rng.randint(0, 30)).upper()) for i in range(40)] + [(40, None), (41, " a\n b\tc  d a ")]
    items = [(f"i{i}", draw(rng.randint(0, 60))) for i in range(12)] + [("none", None)]
    out = corpus.containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    expected = []
    for i, t in docs:
        if own := grams(t):
            share, item = min((-len(own & grams(x)) / len(own), k) for k, x in items)
            expected.append((i, -share, item if share else None))
    assert sorted(map(tuple, out)) == sorted((i, s + 0.0, k) for i, s, k in expected)


@pytest.mark.parametrize("first, rows", [(1_024, 4_000_000), (1, 4_000_000), (3, 40)])
def test_most_contained_equals_containment(spark, monkeypatch, first, rows):
    """In one pass and in many, with copies, ties and candidates that share nothing."""
    from quillspark.operators import corpus

    rng = random.Random(12)
    draw = lambda n: " ".join(rng.choices("abcd", k=n))
    docs = [(i, draw(rng.randint(0, 30)).upper()) for i in range(40)] + [(40, None), (41, " a\n b\tc  d a "), (42, "p q r s t u")]
    docs += [(50 + i, docs[i][1]) for i in range(10)]
    items = [(f"i{i}", draw(rng.randint(0, 60))) for i in range(12)] + [("none", None), ("i99", docs[3][1]), ("i98", docs[3][1])]
    candidates, scored = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted(((r.doc_id, r.containment, r.best_item) for r in corpus.containment(candidates, scored).collect() if r.best_item), key=lambda r: (-r[1], r[0]))
    monkeypatch.setattr(corpus, "FIRST", first)
    monkeypatch.setattr(corpus, "INDEX_ROWS", rows)
    for k in (1, 10, 100):
        assert list(map(tuple, corpus.most_contained(candidates, scored, k).collect())) == want[:k]


def test_validation_check_sends_no_index_of_all_training_rows(spark, monkeypatch):
    """Before, one part after another of the training rows' index went to all candidates."""
    from quillspark.operators import corpus

    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(corpus, "INDEX_ROWS", 20_000)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))
    assert registry.queries()["x22_train_validation_check"](spark, "/root/testdata/sf0.001").count() == 10
    assert len(sent) < 4


def test_overlap_clusters_equal_all_pairs(spark):
    from quillspark.operators import corpus

    rng = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(60):
        at, n = rng.randrange(30), rng.randint(1, 14)
        docs.append((i, " ".join(base[at : at + n] + [f"x{rng.randrange(50)}"] * rng.randint(0, 6))))
    docs += [(60, docs[3][1]), (61, ""), (62, None)]
    for threshold in (0.3, 0.7, 1.0):
        got = dict(map(tuple, corpus.overlap_clusters(spark.createDataFrame(docs, "doc_id long, text string"), threshold).collect()))
        sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))} for i, t in docs if t}
        label = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if len(sets[a] & sets[b]) >= threshold * min(len(sets[a]), len(sets[b])):
                        label[a] = label[b] = min(label[a], label[b])
        assert got == label


def test_pages_are_read_from_files_with_truth_beside(spark, tmp_path):
    import json

    from quillspark.sources import fixtures, writers

    for i, stem in enumerate(["a", "b"]):
        (tmp_path / f"{stem}.pgm").write_bytes(b"P5\n# made\n3 2\n255\n" + bytes(range(i, i + 6)))
        (tmp_path / f"{stem}.json").write_text(json.dumps({"family": stem, "lines": ["x y"], "glyphs": []}, indent=1))
    pages = {r.stem: r for r in fixtures.pages_with_truth(spark, str(tmp_path)).collect()}
    assert (pages["b"].w, pages["b"].h, bytes(pages["b"].pixels), pages["b"].lines, pages["b"].px_per_em) == (3, 2, bytes(range(1, 7)), ["x y"], 0.0)
    (tmp_path / "c.pgm").write_bytes(b"P5\n1 1\n255\n\0")
    with pytest.raises(Exception, match="no truth beside c"):
        fixtures.pages_with_truth(spark, str(tmp_path)).collect()
    found = fixtures.discover_fixtures(spark, {"page": (str(tmp_path), ".pgm"), "truth": (str(tmp_path), ".json")})
    assert {r.stem: (r.page, r.truth) for r in found.collect()} == {"a": (True, True), "b": (True, True), "c": (True, False)}
    assert [tuple(r) for r in fixtures.missing_members(found).collect()] == [("c", "truth")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        fixtures.read_pages(spark, str(tmp_path / "empty"))
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "d.pgm").write_bytes(b"P5\n2 2\n255\nabc")
    with pytest.raises(Exception, match="not a P5 graymap: d"):
        fixtures.read_pages(spark, str(tmp_path / "short")).collect()
    assert fixtures.assert_train_dir("/x/pages-train/") == "/x/pages-train/"
    with pytest.raises(ValueError):
        fixtures.assert_train_dir("/x/pages-score")
    golden = spark.createDataFrame([("g", '{"fixture": "g", "stage": "feature", "dims": 2, "values": [1.5]}')], "stem string, value string")
    with pytest.raises(Exception, match="not a golden vector: g"):
        fixtures.parse_golden(golden).collect()
    bad = ['{"positions": [[["a", 1]]]}', '{"why": "w", "positions": []}', '{"why": "w", "positions": [[]]}', '{"why": "w", "positions": [[["ab", 1]]]}', '{"why": "w", "positions": [[["a", "x"]]]}']
    for text in bad:
        with pytest.raises(Exception, match="not a lattice: f"):
            fixtures.parse_lattice(spark.createDataFrame([("f", text)], "stem string, value string")).collect()
    row = fixtures.parse_lattice(spark.createDataFrame([("f", '{"why": "w", "params": {"decode.beam_width": 2}, "positions": [[["a", 1], ["b", 0.5]]]}')], "stem string, value string")).first()
    assert row.params == {"decode.beam_width": 2.0} and [(c.ch, c.distance) for c in row.positions[0]] == [("a", 1.0), ("b", 0.5)]
    text = spark.createDataFrame([("f", 'q"\\/ü', True, "1.50")], "a string, b string, c boolean, d string").select(fixtures.expectation_json(*map(F.col, "abcd")).alias("j")).first().j
    assert json.loads(text) == {"fixture": "f", "stage": "decode", "text": 'q"\\/ü', "identifier": True, "score": "1.50"}
    charset = tmp_path / "charset.tsv"
    charset.write_text("#head\n0\tU+0041\tA\tl\ta\t0\t1\tm\t-1\t-\n2\tU+0042\tB\tl\ta\t0\t1\tm\t-1\t-\n")
    with pytest.raises(ValueError, match="out of sequence"):
        fixtures.read_charset(spark, str(charset))


def test_recognition_from_bytes(spark):
    from quillspark.operators.pages import typeset
    from quillspark.plans.engine import face, face_bank

    class Session:
        pass

    Session.spark = spark
    lines = [(1, 0, "HELLO WORLD"), (1, 1, "A 1"), (2, 0, ""), (3, 0, None), (4, 0, "_Z_")]
    pages = typeset(spark.createDataFrame(lines, "page int, line int, text string"), face())
    e = Engine(face_bank(Session))
    words = sorted((r.page, r.line, r.word, r.text, r.x0, r.y0, r.x1, r.y1) for r in e.recognize_bytes(pages).collect())
    truth = {r.page: r.glyphs for r in pages.collect()}
    expected = []
    for page, line, text in lines:
        glyphs, at = [g for g in truth[page] if g.line == line], 0
        for n, word in enumerate((text or "").split()):
            own, at = glyphs[at : at + len(word)], at + len(word)
            expected.append((page, line, n, word, own[0].x, own[0].y, own[-1].x + own[-1].w, own[-1].y + own[-1].h))
    assert words == expected
    with pytest.raises(Exception, match="5 pixels, not 2 x 3"):
        e.recognize_bytes(spark.createDataFrame([(1, 2, 3, bytearray(5))], "page int, width int, height int, pixels binary")).collect()
    assert e.set_knob("match.geometry_weight", 0.5) and e.weights == [1.0] * 103 + [0.5] * 4
    assert e.set_knob("match.top_k", 1.0) and not e.set_knob("no.such", 1.0) and not e.set_knob("match.geometry_weight", float("nan"))


def plain_script(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j - 1] + (x != y), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out, i, j = [("match" if a[i - 1] == b[j - 1] else "sub", a[i - 1], b[j - 1]), *out], i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out, i = [("del", a[i - 1], ""), *out], i - 1
        else:
            out, j = [("ins", "", b[j - 1]), *out], j - 1
    return out


@pytest.mark.parametrize("bits", [0, 300, 1 << 26])
def test_edit_steps_by_blocks(monkeypatch, bits):
    monkeypatch.setattr(scoring, "BLOCK_BITS", bits)
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(30))) for _ in range(2))
        assert scoring.edit_steps(a, b) == plain_script(a, b) and scoring.edit_steps(list(a), list(b)) == plain_script(a, b)
        assert scoring.distance(a, b) == plain_distance(a, b)


def test_alignments_of_any_length(spark):
    rows = [(1, "a" * 5000, "b" * 5000), (2, None, "x"), (3, "", "xy"), (4, "ab", "b")]
    pairs = spark.createDataFrame(rows, "i int, ref string, got string")
    want = {("a", "b"): 5000, ("", "x"): 1, ("", "y"): 1, ("a", ""): 1}
    assert {(r.want, r.got): r.n for r in scoring.substitution_counts(pairs, "ref", "got").collect()} == want
    aligned = scoring.align_characters(pairs, ["i"], "ref", "got")
    assert {(r.want, r.got): r.n for r in scoring.substitutions(aligned).collect()} == want
    assert [tuple(r) for r in aligned.filter("i = 4").orderBy("step").collect()] == [(4, 0, "del", "a", ""), (4, 1, "match", "b", "b")]
    assert scoring.line_matched_errors(["a" * 5000], ["a" * 4990 + "b" * 10]) == (10, 5000, 1)
    words = spark.createDataFrame([("a " * 5000, "b " * 5000)], "ref string, got string")
    assert scoring.aligned_words(words, [], "ref", "got").filter("want = 'a' and got = 'b' and at = pos").count() == 5000


def test_character_counts_code_no_tokens(spark):
    pairs = spark.createDataFrame([("a b", "a c"), ("", "x"), (None, "x")], "ref string, got string")
    counts = scoring.edit_counts(pairs, "ref", "got").select("char_errors", "chars", "words")
    assert "array_position" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, counts.collect()), key=repr) == [(1, 0, 0), (1, 3, 2), (None, None, None)]


@pytest.mark.parametrize("block, bank_bytes", [(3, 1 << 20), (7, 200)])
def test_search_by_blocks(spark, monkeypatch, block, bank_bytes):
    """Small blocks and slices give what a plain search gives, with ties, gates and vectors that have no distance."""
    from quillspark.operators import matching

    monkeypatch.setattr(matching, "BLOCK", block)
    monkeypatch.setattr(matching, "BANK_BYTES", bank_bytes)
    rng = random.Random(3)
    bank = [(i, f"c{i % 4}", [float(rng.randrange(3)), float(rng.randrange(3))], rng.randrange(1, 4), i) for i in range(40)] + [(40, "c1", [float("nan"), 0.0], 3, 40), (41, "c2", None, 3, 41)]
    queries = [(100 + i, [float(rng.randrange(3)), float(rng.randrange(3))], rng.randrange(3), i) for i in range(20)] + [(200, None, 0, 0), (201, [float("inf"), 0.0], 0, 1)]
    b = spark.createDataFrame(bank, "proto_id long, class string, vec array<double>, holes int, own long")
    q = spark.createDataFrame(queries, "q long, vec array<double>, hole int, own long")
    for gate in (False, True):
        want = {}
        for n, x, hole, own in queries[:20]:
            rows = [r for r in bank[:40] if r[4] != own]
            rows = [r for r in rows if r[3] >> hole & 1] or rows if gate else rows
            for p, c, v, *_ in rows:
                d = float(np.float32(np.hypot(v[0] - x[0], v[1] - x[1])))
                want[n, c] = min(want.get((n, c), (d, p)), (d, p))
        got = {(r.q, r["class"]): (r.d, r.proto_id) for r in matching.class_distances(q, b, gate=gate, exclude="own").collect()}
        assert got == want


def test_search_deals_few_files_over_all_cores(spark):
    from quillspark.operators import matching

    v = spark.range(10).coalesce(1).selectExpr("id AS q", "id AS proto_id", "id % 2 AS class", "array(double(id)) AS vec")
    assert matching.class_distances(v, v).rdd.getNumPartitions() >= 4


def test_contrast_ends_round_as_in_sql(spark):
    import duckdb

    from quillspark.operators import raster

    images = [(i, [a, b, *[255] * 62]) for i, (a, b) in enumerate((a, b) for a in range(0, 90, 3) for b in range(a, 250, 7))]
    px = spark.createDataFrame([(i, 0, x, v) for i, vs in images for x, v in enumerate(vs)], "img int, y int, x int, v int")
    got = {r.img: (r.lo, r.hi) for r in raster.quantiles(px, lo=0.005, hi=0.5).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE p (img INT, v INT[])")
    con.executemany("INSERT INTO p VALUES (?, ?)", images)
    want = con.execute("SELECT img, quantile_cont(u, 0.005), quantile_cont(u, 0.5) FROM (SELECT img, unnest(v) AS u FROM p) GROUP BY img").fetchall()
    assert got == {i: (lo, hi) for i, lo, hi in want}


def test_pretokens_of_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["t37_pretokens"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, True, None), (2, None, None, None), (3, 2, True, "a")]


def test_category_veto_sorts_words_once(spark):
    from quillspark.operators import matching

    rows = [(1, 1, "A", "X"), (1, 2, "A", "A"), (2, 1, "A", "X"), (2, 2, "B", "B"), (3, 1, "A", "X"), (3, 2, None, None), (4, 1, None, "X"), (4, 2, None, "X")]
    out = matching.category_veto(spark.createDataFrame(rows, "word int, pos int, category string, other string"))
    assert [r.vetoed for r in out.orderBy("word", "pos").collect()] == [True, False, False, False, False, False, None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1


@pytest.mark.parametrize("pixels", [1 << 20, 100])
def test_deskew_of_odd_images(spark, monkeypatch, pixels):
    """Images of unlike sizes, without ink, of one pixel and with values that aren't numbers, at once and in slices."""
    import math

    from quillspark.operators import raster

    monkeypatch.setattr(raster, "PIXELS", pixels)
    rng = random.Random(4)
    images = [(i, [rng.uniform(-0.4, 0.4) for _ in range(rng.choice([64, 64, 64, 60, 9, 1]))]) for i in range(40)]
    images += [(40 + s, [-0.3 if (y - round(x * s / 8)) % 4 == 0 else 0.3 for y in range(8) for x in range(8)]) for s in (-2, -1, 1, 2)]
    images += [(50, [1.0] * 64), (51, None), (52, []), (53, [None, float("nan"), -0.3, float("inf")] * 16)]

    def plain(vector):
        v = [255 if e is None or e == math.inf else 0 if e != e else max(0, min(255, math.floor(e * 400 + 128))) for e in vector]
        px = {divmod(i, 8): g for i, g in enumerate(v)}
        h, w = max(y for y, _ in px), max(x for _, x in px)
        slope, span = 0.0, 0.25
        for step in (1 / 128, 1 / 1024, 1 / 8192):
            tried = []
            for i in range(-round(span / step), round(span / step) + 1):
                k = max(-0.25, min(0.25, slope + i * step))
                rows = [math.floor(y - x * k) for (y, x), g in px.items() if g < 128]
                tried.append((-sum(rows.count(r) ** 2 for r in set(rows)), abs(k), k))
            slope, span = min(tried)[2], step
        edge = sorted(g for (y, x), g in px.items() for _ in range((y in (0, h)) + (x in (0, w))))
        fill = edge[len(edge) // 2]
        out = {}
        for (y, x), g in px.items():
            y0 = math.floor(y + x * slope)
            part = y + x * slope - y0
            v0, v1 = px.get((y0, x), fill), px.get((y0 + 1, x), fill) if (y0, x) in px else fill
            out[y, x] = g if abs(slope) < 0.0015 else math.floor(v0 * (1 - part) + v1 * part + 0.5)
        return slope, out

    want = {(i, y, x): (v, slope) for i, vector in images if vector and i != 50 for slope, out in [plain(vector)] for (y, x), v in out.items()}
    table = spark.createDataFrame([(i, v) for i, v in images], "vec_id long, embedding array<double>")
    got = {(r.img, r.y, r.x): (r.v, r.slope) for r in raster.deskew(table, "vec_id", "embedding", 8, max_slope=0.25).collect()}
    assert got == {k: w for k, w in want.items() if any(e is not None and (e != e or e < 0) for e in dict(images)[k[0]])}


def test_deskew_aggregates_no_pixels(spark):
    """Before, a task held counts for each slope and row of all its images."""
    plan = registry.queries()["p04_p07_p22_deskew"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Aggregate|Window|Join|Generate", plan)
