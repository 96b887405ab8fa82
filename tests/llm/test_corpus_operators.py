"""The ten operators against brute force, round trips and odd inputs, on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, embedding_dedup, html_text, line_dedup, packing, quality, sharding, simhash, token_files, warc
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.wordcache import WordCachedEncoder, read_tokenizer

DOCS = "doc_id long, text string, mix string, key string, fp string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "m", "k", "f") for i, t in rows], DOCS)


def sample_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "x-y", "A"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, ""), (63, None), (None, "w1 w2 w3"), (7, rows[7][1]), (64, "word " * 5000), (65, " \n "), (66, "a\n\nb  c <|endoftext|> d")]
    return rows


def whole_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_cache_equals_whole_encoding():
    encoder, whole = WordCachedEncoder(read_tokenizer(tokenizer_path())), whole_encoder()
    rng = random.Random(1)
    pieces = [" ", "\n", "a", "the", "'s", "!", ".", "é", "\t", " ", "1", "<|endoftext|>", "中", "\x1c", "\r", "²"]
    for _ in range(5000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 8)))
        assert encoder.encode(text) == np.array(whole(text), "<u4").tobytes(), text


def test_token_files_round_trip(spark):
    rows, whole = sample_rows(), whole_encoder()
    out = token_files.read_token_files(token_files.write_token_files(docs(spark, rows), tokenizer_path(), partitions=3)).collect()
    expected, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole(t) + [2]
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), tokenizer_path())).count() == 0


def test_packing(spark):
    rows, whole = sample_rows(), whole_encoder()
    out = packing.pack_documents(docs(spark, rows), tokenizer_path(), capacity=128, group_docs=30).collect()
    for r in out:
        assert 0 < r.length and r.offset + r.length <= 128
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in spans.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
    wanted = sorted(((i, s, crc((whole(t) + [1])[s : s + 128])) for i, t in rows for s in range(0, len(whole(t)) + 1, 128)), key=repr)
    assert sorted(((r.doc_id, r.start, r.ids_crc32) for r in out), key=repr) == wanted
    assert packing.pack_documents(docs(spark, []), tokenizer_path()).count() == 0


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 60))]
        bins, placed = [], [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            b = next((k for k, used in enumerate(bins) if used + lengths[i] <= 20), len(bins))
            if b == len(bins):
                bins.append(0)
            placed[i] = (b, bins[b])
            bins[b] += lengths[i]
        assert packing.first_fit_decreasing(lengths, 20) == placed


def best_capacity(sizes, shards):
    def feasible(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if feasible(c))


def test_sharding_is_minimax(spark):
    rows = sample_rows()
    out = sharding.shard_documents(docs(spark, rows), shards=5, slot_rows=7).collect()
    assert len(out) == len(rows)
    groups = docs(spark, rows).select(F.xxhash64("text").alias("k"), (F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) + 1).alias("s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
    sizes = [r.s for r in sorted(groups, key=lambda r: r.k & (2**64 - 1))]
    loads = {}
    for r in out:
        loads.setdefault(r.shard, []).append(r)
    assert max(sum(r["size"] for r in v) for v in loads.values()) == best_capacity(sizes, 5)
    for v in loads.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    assert len({r.shard for r in out if r.doc_id in (3, 60, 61)}) == 1
    assert sharding.shard_documents(docs(spark, []), 5).count() == 0


def test_shards_are_near_equal(spark):
    rng = random.Random(3)
    for hot in (0, 40_000):
        sizes = [rng.randint(1, 60) for _ in range(3000)] + [hot] * (hot > 0)
        keys = [rng.getrandbits(64) - 2**63 for _ in sizes]
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
        capacity, cuts = sharding.minimax_cuts(groups, 16)
        ordered = sorted((k % 2**64, s) for k, s in zip(keys, sizes))
        assert capacity == best_capacity([s for _, s in ordered], 16) and len(cuts) == 15
        loads = [0] * 16
        for k, s in ordered:
            loads[sum(k >= c for c in cuts)] += s
        assert max(loads) <= capacity
        rest = sorted(loads)[: 15 if hot else 16]
        mean = sum(rest) / len(rest)
        assert sum(abs(x - mean) <= 60 for x in rest) >= len(rest) - (2 if hot else 0)
        assert hot == 0 or hot in loads


def test_starts_hold_the_capacity():
    rng = random.Random(5)
    for _ in range(500):
        sizes = [rng.choice((1, 2, 5, 40)) for _ in range(rng.randint(1, 40))]
        shards = rng.randint(1, 9)
        capacity = best_capacity(sizes, shards)
        starts, coarse = sharding._even_starts([sharding.KeyRange(64, i, s, 1, s) for i, s in enumerate(sizes)], capacity, shards)
        edges = [0, *starts, len(sizes)]
        assert not coarse and edges == sorted(edges) and len(starts) == shards - 1
        assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) == capacity


def plain_fingerprint(text):
    """A fingerprint bit by bit, from the contract's own words."""
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_long_texts_are_taken_in_slices(monkeypatch):
    rng = random.Random(2)
    text = "\n ".join(" ".join(f"W{rng.randrange(500)}é" for _ in range(rng.randint(1, 9))) for _ in range(300)) + " " + "x" * 400
    whole = np.concatenate(list(simhash.shingle_slices(text, 3)))
    measured = quality.measure(text)
    monkeypatch.setattr(simhash, "SLICE", 100)
    monkeypatch.setattr(quality, "SLICE", 100)
    parts = list(simhash.shingle_slices(text, 3))
    assert len(parts) > 50 and (np.concatenate(parts) == whole).all()
    assert simhash.majority_fingerprint(parts) == plain_fingerprint(text)
    assert quality.measure(text) == pytest.approx(measured)


def test_simhash_components(spark):
    rng = random.Random(2)
    base = " ".join(f"t{i}" for i in range(300))
    rows = sample_rows() + [(100 + k, base.replace(f"t{rng.randrange(300)} ", "zz ", 1)) for k in range(20)]
    out = simhash.simhash_components(docs(spark, rows), k=2)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in out.collect()), key=repr)
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), lab in zip(fps, label):
        if i is not None:
            least[lab] = min(least.get(lab, i), i)
    assert got == sorted(((i, f, least.get(lab)) for (i, f), lab in zip(fps, label)), key=repr)


def test_simhash_hot_buckets_are_split_exactly(spark, monkeypatch):
    rng = random.Random(9)
    fps = {rng.getrandbits(60) for _ in range(5)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps) for _ in range(30)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    plain = simhash.connected_components(simhash.fingerprint_edges(frame)).collect()
    monkeypatch.setattr(simhash, "BUCKET", 3)
    split = simhash.connected_components(simhash.fingerprint_edges(frame)).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, split)) and plain


def test_near_duplicates_at_a_similarity(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, planted = [], {}
    for i in range(0, 400, 2):
        words = fresh(200)
        rows.append((i, " ".join(words)))
        if i % 8 == 0:
            at = rng.randrange(190)
            rows.append((i + 1, " ".join(words[:at] + fresh(1) + words[at + 1 :])))
            planted[i + 1] = i
    out = {r.doc_id: r.keep for r in simhash.near_duplicate_groups(docs(spark, rows)).collect()}
    assert sum(out[k] == v for k, v in planted.items()) >= 0.95 * len(planted)
    assert all(out[i] == i for i, _ in rows if i not in planted)


def test_large_groups_are_searched_in_chunks(spark, monkeypatch):
    """A large group of near copies in many small tasks gives what one task gives; chains hang on by their ends."""
    rng = random.Random(14)
    base = [f"b{i}" for i in range(120)]
    texts = [base]
    for _ in range(150):
        at = rng.randrange(118)
        texts.append(base[:at] + [f"c{rng.randrange(10**6)}"] + base[at + 1 :])
    chain, outsiders = base, 12
    for _ in range(outsiders):  # each is like the one before, and soon unlike the base
        at = rng.randrange(118)
        chain = chain[:at] + [f"d{rng.randrange(10**6)}"] + chain[at + 1 :]
        texts.append(chain)
    texts += [[f"e{k}_{i}" for i in range(100)] for k in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    plain = sorted(map(tuple, simhash.near_duplicate_groups(docs(spark, rows)).collect()))
    monkeypatch.setattr(simhash, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(simhash, "WIDE_BUCKET", 30)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    assert sorted(map(tuple, simhash.near_duplicate_groups(docs(spark, rows)).collect())) == plain
    assert sum(keep == 0 for _, _, keep in plain) == 151 + outsiders


def test_short_texts_merge_only_with_their_like(spark):
    rng = random.Random(5)
    texts = {" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randint(1, 6))) for _ in range(4000)}
    rows = list(enumerate(sorted(texts)))
    base = [f"b{i}" for i in range(9)]  # five shingles
    n = len(rows)
    rows += [(n, " ".join(base)), (n + 1, " ".join(base[:8])), (n + 2, " ".join(base[:7])), (n + 3, " ".join(base).upper()), (n + 4, ""), (n + 5, None)]
    out = {r.doc_id: r.keep for r in simhash.near_duplicate_groups(docs(spark, rows)).collect()}
    assert all(out[i] == i for i in range(n))
    # 4 of 5 shingles are shared, then 3 of 4
    assert [out[n + i] for i in range(6)] == [n, n, n + 2, n, n + 4, n + 4]


@pytest.mark.parametrize("shingles", [9, 300])
def test_near_duplicates_by_their_true_similarity(spark, shingles):
    """Pairs at 0.8 are found and none below is merged: each pair differs in its last words only."""
    rng = random.Random(6)
    n, rows, true = 0, [], {}
    for other in range(40) if shingles == 300 else (0, 1, 2):
        for _ in range(20 if shingles == 300 else 200):
            words = [f"v{rng.randrange(10**6)}" for _ in range(shingles + 4)]
            changed = other if shingles == 9 else 25 + other
            rows += [(n, " ".join(words)), (n + 1, " ".join(words[: len(words) - changed] + [f"x{rng.randrange(10**6)}" for _ in range(changed)]))]
            true[n + 1] = (shingles - changed) / (shingles + changed)
            n += 2
    out = {r.doc_id: r.keep for r in simhash.near_duplicate_groups(docs(spark, rows)).collect()}
    assert all(out[i] == i for i, s in true.items() if s < 0.8)
    assert all(out[i] in (i, i - 1) for i in true)
    found = [out[i] == i - 1 for i, s in true.items() if s >= 0.8]
    assert len(found) >= 180 and sum(found) >= 0.95 * len(found)


def test_decontamination(spark):
    rows = sample_rows()
    items = [(1, "w1 w2 w3"), (2, rows[68][1]), (10, " ".join(rows[5][1].split()[:15])), (3, ""), (4, None), (5, "nothing here of that kind")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (50_000_000, 1_000):
        out = decontamination.decontaminate(docs(spark, rows), bench, max_window_words=limit).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out), key=repr)
        expected = []
        for i, t in rows:
            w = [x.decode() for x in decontamination.words(t)]
            hit, found = set(), set()
            for item, text in items:
                for win in decontamination.windows(text, 10):
                    win = [x.decode() for x in win]
                    for s in range(len(w) - len(win) + 1):
                        if w[s : s + len(win)] == win:
                            hit |= set(range(s, s + len(win)))
                            found.add(str(item))
            expected.append((i, len(w), len(hit), tuple(sorted(found))))
        assert got == sorted(expected, key=repr)
    assert decontamination.decontaminate(docs(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("slop", [0, 1, 2, 3])
def test_proximity_matches(spark, monkeypatch, slop):
    """Every window against every place of every document, at their starts and ends too."""
    monkeypatch.setattr(decontamination, "PLACES", 50)
    rng = random.Random(20 + slop)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 14)))) for i in range(40)] + [(40, "b x x x x x a"), (41, "a b"), (42, "b a"), (43, "x x x x x x b x x x x x a")]
    items = [(1, "b a"), (2, "a b c"), (3, "c"), (4, " ".join(rng.choices("abcdef", k=9)))]
    out = decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=4, slop=slop).collect()
    every = [w.decode() for _, t in rows for w in decontamination.words(t)]
    expected = []
    for i, t in rows:
        w, hit, found = t.split(), set(), set()
        for item, text in items:
            for win in decontamination.windows(text, 4):
                win = [x.decode() for x in win]
                rarest = min(range(len(win)), key=lambda k: (every.count(win[k]), k))
                for p in range(len(w)):
                    if w[p] != win[rarest]:
                        continue
                    near = [[q for q in range(max(0, p + k - rarest - slop), p + k - rarest + slop + 1) if q < len(w) and w[q] == x] for k, x in enumerate(win)]
                    near[rarest] = [p]
                    if all(near):
                        hit |= {q[0] for q in near}
                        found.add(str(item))
        expected.append((i, len(w), len(hit), tuple(sorted(found))))
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out) == sorted(expected)


def test_long_items_are_cut_with_all_their_windows(spark):
    rng = random.Random(7)
    long = [f"t{rng.randrange(300)}" for _ in range(2000)]
    rows = [(i, " ".join(long[at : at + 12])) for i, at in enumerate(range(0, 1988, 11))]
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    out = decontamination.decontaminate(docs(spark, rows), bench, max_window_words=8_000).collect()
    assert len(out) == len(rows) and all(r.n_hit == 12 and r["items"] == ["1"] for r in out)


def test_line_dedup(spark):
    passage = "\n".join(" ".join(f"p{j}_{i}" for i in range(15)) for j in range(4))
    rows = [(1, f"start one\n{passage}\nend one"), (2, f"other\n{passage}\nlast"), (3, "start one\nother\nlonely words"), (4, f"x y\n{passage}\n{passage}"), (5, None), (None, passage), (6, "")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "other\nlast" and out[2].lines_deleted == 4
    assert out[3].text == rows[2][1] and out[5].text is None and out[None].text == passage and out[6].text == ""
    assert out[4].text == "x y"
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_equals_a_plain_comparison(spark):
    rng = random.Random(8)
    kinds = ["", "one two three", " one two three ", "a b", "c d e f", "g", "h i j k l m n", "o p q r s t u v w"]
    rows = [(i, "\n".join(rng.choices(kinds, k=rng.randint(0, 14)))) for i in range(60)]
    rows += [(60, rows[9][1]), (9, rows[9][1]), (61, "\n".join(rows[9][1].split("\n")[::-1]))]
    split = [(i, [line.strip(" ") for line in t.split("\n")]) for i, t in rows]

    def plain(doc, lines):
        gone = set()
        for other, theirs in split:
            for shift in range(-len(theirs), len(lines)) if other < doc else ():
                block = []
                for q in range(len(lines) + 1):
                    if q < len(lines) and 0 <= q - shift < len(theirs) and lines[q] == theirs[q - shift]:
                        block.append(q)
                        continue
                    while block and not lines[block[-1]]:
                        block.pop()
                    while block and not lines[block[0]]:
                        block.pop(0)
                    if sum(len(lines[b].split()) for b in block) >= 12:
                        gone.update(block)
                    block = []
        return len(gone)

    got = sorted((r.doc_id, r.lines_deleted) for r in line_dedup.dedup_lines(docs(spark, rows), min_words=12).collect())
    assert got == sorted((i, plain(i, lines)) for i, lines in split) and any(n for _, n in got)


def test_line_dedup_equals_a_plain_aligner(spark):
    """Each later document is aligned with every earlier one, by a patience diff of the test's own."""
    rng = random.Random(18)
    blocks = [[" ".join(f"b{k}_{j}_{i}" for i in range(rng.randint(2, 9))) for j in range(rng.randint(1, 4))] for k in range(8)]
    rows = []
    for d in range(50):
        parts = [rng.choice(blocks) if rng.random() < 0.6 else [f"own {d} {n}"] for n in range(rng.randint(1, 8))]
        rows.append((d, "\n".join(line for part in parts for line in part)))
    split = [(i, t.split("\n")) for i, t in rows]

    def align(pairs):
        if not pairs:
            return []
        single = [(i, j) for i, j in pairs if sum(p[0] == i for p in pairs) == 1 == sum(p[1] == j for p in pairs)]
        steps, best = sorted(single or pairs, key=lambda p: (p[0], -p[1])), {}
        for i, j in steps:
            best[i, j] = max((best[p] for p in best if p[0] < i and p[1] < j), key=len, default=[]) + [(i, j)]
        chain = max(best.values(), key=len)
        if not single:
            return chain
        out, low = [], (-1, -1)
        for high in chain + [(10**9, 10**9)]:
            out += align([p for p in pairs if low[0] < p[0] < high[0] and low[1] < p[1] < high[1]])
            out += [high] if high[0] < 10**9 else []
            low = high
        return out

    def runs(pairs, lines):
        pairs, found = set(pairs), []
        for i, j in pairs:
            if (i - 1, j - 1) not in pairs:
                n = 1
                while (i + n, j + n) in pairs:
                    n += 1
                if sum(len(s.split()) for s in lines[i : i + n]) >= 12:
                    found.append([(i + k, j + k) for k in range(n)])
        return found

    def plain(doc, lines):
        gone = set()
        for _, theirs in (x for x in split if x[0] < doc):
            every = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(theirs) if a == b}
            left = runs(every, lines)
            while left:  # align, delete the aligned blocks, and go on with the blocks that aren't aligned whole
                aligned = set(align(sorted({p for r in left for p in r})))
                gone |= {i for r in runs(aligned, lines) for i, _ in r}
                rest = [r for r in left if not aligned.issuperset(r)]
                if len(rest) == len(left):
                    gone |= {i for i, _ in rest.pop()}
                left = rest
        return len(gone)

    got = sorted((r.doc_id, r.lines_deleted) for r in line_dedup.dedup_lines(docs(spark, rows), min_words=12).collect())
    assert got == sorted((i, plain(i, lines)) for i, lines in split) and sum(n > 0 for _, n in got) > 20


def test_patience_diff_aligns():
    rng = random.Random(3)
    for _ in range(300):
        matches = {(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randint(0, 14))}
        out = line_dedup.patience_diff(set(matches))
        assert set(out) <= matches and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(out, out[1:])) and bool(out) == bool(matches)
    # anchors first, then what lies between them, grown along equal lines
    assert line_dedup.patience_diff({(0, 0), (1, 1), (1, 3), (2, 2), (3, 3), (3, 1)}) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    runs = [(0, 9, 3), (3, 0, 2), (5, 12, 3), (8, 15, 2)]
    assert line_dedup.aligned_runs(runs, moved=False) == [(0, 9, 3), (5, 12, 3), (8, 15, 2)]
    assert line_dedup.aligned_runs(runs, moved=True) == runs
    assert line_dedup.covered([(4, 3), (0, 2), (2, 1), (5, 1)]) == [(0, 3), (4, 7)]


def test_one_alignment_keeps_moved_lines(spark):
    rng = random.Random(4)
    lines = [" ".join(f"l{k}_{i}" for i in range(12)) for k in range(12)]
    rows, most = [(0, "\n".join(lines))], {0: 0}
    for d in range(1, 15):
        order = rng.sample(range(12), 12)
        best = [1] * 12
        for k in range(12):
            best[k] = 1 + max((best[q] for q in range(k) if order[q] < order[k]), default=0)
        rows.append((d, "\n".join(lines[k] for k in order)))
        most[d] = max(best)
    once = line_dedup.dedup_lines(docs(spark, rows), min_words=12, moved=False).collect()
    assert {r.doc_id: r.lines_deleted for r in once} == most
    assert all(r.lines_deleted == 12 * (r.doc_id > 0) for r in line_dedup.dedup_lines(docs(spark, rows), min_words=12).collect())


def test_line_dedup_keeps_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    names = ["__id", "__deleted", "__key", "key", "row", "ranges", "n_deleted", "mix", "lines_total"]
    frame = spark.createDataFrame([(i, passage, *[f"{c}{i}" for c in names]) for i in (1, 2)], ["doc_id", "text", *names])
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert out[1].text == passage and out[2].text == "" and out[2].lines_total == 1
    assert all(out[2][c] == f"{c}2" for c in names[:-1])


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(100):
        v = [rng.randrange(12) for _ in range(rng.randint(0, 10))]
        best = [0] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        out = [v[i] for i in line_dedup.longest_increasing(v)]
        assert all(a < b for a, b in zip(out, out[1:])) and len(out) == max(best, default=0)


@pytest.mark.parametrize("chunk", [2048, 16])
def test_embedding_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(120):
        v = centres[i % 6] + rng.normal(size=24) * (0.05, 0.3, 0.45)[i % 3]
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [0.0] * 24, 0), (203, None, 0), (204, rows[0][1], None), (205, [float("nan")] * 24, 0), (206, [1.0, 2.0], 0), (207, [1.0, 2.1], 0)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, id int, copies int, slab int")
    assert embedding_dedup.embedding_links(frame.limit(0)).count() == 0
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(frame).collect()}

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array(r[1], np.float32).astype(float) for r in (a, b))
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return bool(np.isfinite(n) and n > 0 and x @ y / n >= 0.93)

    near = {a[0]: [b[0] for b in rows if b[0] != a[0] and linked(a, b)] for a in rows}
    for i, links in near.items():
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(links), min(seen), min(seen) == i), i


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 700)
    big = "<p>ü" * 900
    rows = [(1, "http://a/ü b", big), (2, None, big), (9, "http://c", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "n", big), (9, "http://c", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    manifest = warc.write_archives(warc.chunk_rows(warc.warc_records(pages)))
    table = warc.read_archives(manifest)
    data = {}
    for r in table.filter("record_type = 'response'").orderBy("page_id", "chunk").collect():
        assert len(r.data) <= 1 << 20
        data.setdefault(r.page_id, []).append(bytes(r.data))
    assert b"".join(data[3]) == b"small" and b"".join(data[9])[: len(big.encode())] == big.encode()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=repr)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and i != 9
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(expected, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\ntext<p>Short.<ul><li>one<li>two</ul><script>var x = "</p>";</script><form><input>go</form></article>
<aside>More</aside><div class="comments"><p>A reader</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst bold text\nShort.\none\ntwo"
    assert html_text.main_text("") == html_text.main_text(None) == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>just <i>text</i></p>") == "just text"
    long = "words " * 40
    soup = f"<div id=menu><a href=1>a</a><a href=2>b</a></div><div id=w><div id=main><p>{long}</p><p>{long}</p><p>Tiny.</p></div></div><div class=footer>f</div>"
    assert html_text.main_text(soup) == "\n".join([long.strip()] * 2 + ["Tiny."])
    assert html_text.main_text("<article><p>" + "x" * 300_000) == "x" * 300_000


def test_main_text_is_whole():
    big, part = "word " * 180, "more " * 20
    a, b = big.strip(), part.strip()
    assert html_text.main_text(f"<div><h1>T</h1><p>{big}</p><p>{part}</p></div>") == f"T\n{a}\n{b}"
    assert html_text.main_text(f"<body><nav>n</nav><div><section><h2>A</h2><p>{big}</p></section><section><h2>B</h2><p>{part}</p></section></div></body>") == f"A\n{a}\nB\n{b}"
    assert html_text.main_text(f"<div><h1>T</h1><p><b>{big}</b></p><p>End.</p></div>") == f"T\n{a}\nEnd."
    # an article in two elements, and one beside a teaser
    assert html_text.main_text(f"<article><h1>T</h1><p>{big}</p></article><article><p>{big}</p><p>{part}</p></article>") == f"T\n{a}\n{a}\n{b}"
    assert html_text.main_text(f"<main><h1>T</h1><p>{big}</p><p>{big}</p><article><p>Teaser</p></article></main>").startswith(f"T\n{a}\n{a}")


def test_articles_of_the_pages_are_found_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as h

    for r in html_text.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        plain = [" ".join(h.unescape(re.sub(r"</?(?:b|br|i)\b[^>]*>", " " if "br" in s else "", s)).split()) for s in re.split(r"</?(?:p|h1)>", body)]
        assert r.text.split("\n") == [s for s in plain if s]
        assert r.n_chars == len(r.text)


def test_clusters_choose_the_region(monkeypatch):
    big = ("word " * 60).strip()
    # the tags decide nothing where clusters are elsewhere: a teaser of links in an article, the text in a block
    links = "".join(f"<li><a href={i}>item {i}</a></li>" for i in range(30))
    page = f"<body><article><ul>{links}</ul></article><div><h2>T</h2><p>{big}</p><p>{big}</p><p>{big}</p><p>End.</p></div></body>"
    assert html_text.main_text(page) == "\n".join(["T", big, big, big, "End."])
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for r in table:
        assert html_text.main_text(re.sub(r"<(/?)article\b", r"<\1div", r["html"])) == html_text.main_text(r["html"]), r["page_id"]
    monkeypatch.setattr(html_text, "smoothed", lambda values: [0.0] * len(values))
    assert not any(html_text.main_text(r["html"]) for r in table)


def test_pages_through_spark(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "y"), (None, "w", "<p>Tiny</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, html_text.extract_pages(pages).collect()), key=repr)
    text = html_text.main_text(PAGE)
    assert out == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "Tiny", 4)], key=repr)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(80)]
        rows.append((i, " ".join(w + "###" if i % 3 == 0 else w for w in words)))
    rows += [(900, ""), (901, None), (None, "some words"), (5, rows[5][1])]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)], "doc_id long, quality int")
    out = quality.score_documents(docs(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    empty = quality.score_documents(docs(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in empty} == {0.5}


def test_quality_keeps_rows_by_their_score(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
        rows.append((" ".join(w + "###" if i % 2 else w for w in words), i, "r", "s"))
    rows += [("", 200, None, "s"), (None, 201, "r", None), (rows[4][0], None, "r", "s"), rows[4], rows[5]]
    frame = spark.createDataFrame(rows, "text string, doc_id long, row string, score string").repartition(3)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(120)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    scores = {(r.doc_id, r.text is None): r.predicted for r in quality.score_documents(frame, labels).join(frame.select(F.col("doc_id").alias("i"), "text"), F.expr("doc_id <=> i")).collect()}
    kept = quality.keep_documents(frame, labels)
    assert kept.columns == frame.columns
    want = [r for r in rows if scores[r[1], r[0] is None]]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr) and 0 < len(want) < len(rows)
    assert quality.keep_documents(frame.limit(0), labels).count() == 0
    assert quality.keep_documents(frame, labels.limit(0)).count() == len(rows)  # each score is 0.5


def test_quality_sample_is_bounded_and_blind_to_copies(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_additive", lambda x, y: seen.append((x, y)))
    rows = [(i, "word " * (i + 1)) for i in range(50)] * 3 + [(7, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    for bound in (10, 1000):
        quality.train(docs(spark, rows), labels, max_rows=bound)
    outside = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert [len(y) for _, y in seen] == [10, len(outside)]
    want = [quality.measure(None if i == 7 else "word " * (i + 1)) for i in outside]
    assert seen[1][0].tolist() == want and seen[1][1].tolist() == [i % 2 for i in outside]


def test_additive_score_equals_plain_sums():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = quality.fit_additive(x, y, pairs=3)
    for row, score in zip(x, model.score(x)):
        place = [sum(e <= v for e in edges) for edges, v in zip(model.edges, row)]
        coarse = [sum(e <= v for e in edges) for edges, v in zip(model.pair_edges, row)]
        total = model.base + sum(t[p] for t, p in zip(model.tables, place)) + sum(t[coarse[f], coarse[g]] for (f, g), t in zip(model.pairs, model.pair_tables))
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_tree_takes_the_best_first_cut():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
        cost = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)
        leaf = lambda a, b: np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 2.0))
        cut = max(range(1, 9), key=lambda k: cost(0, k) + cost(k, 9))
        gains = cost(0, cut) + cost(cut, 9) - cost(0, 9) > 1e-9  # with the ridge, no cut may gain anything
        assert quality._tree(g, h, 2, 2.0) == pytest.approx(np.r_[leaf(0, cut), leaf(cut, 9)] if gains else leaf(0, 9))
