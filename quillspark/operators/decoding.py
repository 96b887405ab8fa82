"""Language tables and sequence decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR = -40.0
MASS = 0.85


def case_shape(token: Column) -> Column:
    """The state that a five-state case automaton ends in; ``mixed`` is an anomaly, non-letters are skipped."""
    return (
        F.when(~token.rlike(r"\p{L}"), "none")
        .when(token.rlike(r"^\P{L}*\p{Lu}\P{L}*$"), "initial")
        .when(token == F.lower(token), "lower")
        .when(token == F.upper(token), "upper")
        .when(token.rlike(r"^\P{L}*\p{Lu}(\P{L}|\p{Ll})*$"), "title")
        .otherwise("mixed")
    )


def log2_or_floor(p: Column, floor: float = FLOOR) -> Column:
    return F.when(p > 0, F.greatest(F.log2(p), F.lit(floor))).otherwise(F.lit(floor))


def bigram_pairs(words: DataFrame) -> DataFrame:
    """Weighted counts of adjacent characters of ``(word, weight)``: ``prev, next, n``; '' is a border."""
    chars = F.split("word", "")
    both = F.arrays_zip(F.concat(F.array(F.lit("")), chars).alias("prev"), F.concat(chars, F.array(F.lit(""))).alias("next"))
    return words.select("weight", F.explode(both).alias("x")).groupBy(F.col("x.prev").alias("prev"), F.col("x.next").alias("next")).agg(F.sum("weight").alias("n"))


def bigram_model(pairs: DataFrame, category: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(logp, row backoff, category logp)``: 0.85 of a row's mass to its pairs, the rest to categories."""
    rows = pairs.withColumn("total", F.sum("n").over(Window.partitionBy("prev")))
    logp = rows.select("prev", "next", log2_or_floor(MASS * F.col("n") / F.col("total")).alias("logp"))
    backoff = pairs.select("prev").distinct().select("prev", log2_or_floor(F.lit(1 - MASS)).alias("backoff"))
    cats = pairs.groupBy(category.alias("category")).agg(F.sum("n").alias("n"))
    total = cats.agg(F.sum("n").alias("total"))
    cat = cats.join(F.broadcast(total)).select("category", log2_or_floor(F.col("n") / F.col("total")).alias("cat_logp"))
    return logp, backoff, cat


def score_bigrams(asked: DataFrame, logp: DataFrame, backoff: DataFrame, cat: DataFrame, category: Column) -> DataFrame:
    """Stored value where there is one, else the row's backoff plus the category's, else the floor.

    The tables are bounded by the character set, squared, and broadcast by Spark within its limit.
    """
    joined = asked.join(logp, ["prev", "next"], "left").join(backoff, "prev", "left").withColumn("category", category).join(cat, "category", "left")
    return joined.select("prev", "next", F.coalesce("logp", F.col("backoff") + F.col("cat_logp"), F.lit(FLOOR)).alias("score"))


def confusion_adjustments(rules: DataFrame) -> DataFrame:
    """Half of each rule's weight to the favoured class and minus half to the other: ``class, context, adjust``."""
    up = rules.select(F.col("favour").alias("class"), "context", (F.col("adjust") / 2).alias("adjust"))
    down = rules.select(F.when(F.col("favour") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("class"), "context", (-F.col("adjust") / 2).alias("adjust"))
    return up.unionByName(down).groupBy("class", "context").agg(F.sum("adjust").alias("adjust")).filter("adjust <> 0")


def adjust(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Sum of a class's adjustments whose context bit is in the mask: ``id, adjust``."""
    hit = asked.join(table, "class", "left").filter("context is null or mask & context <> 0")
    sums = hit.groupBy("id").agg(F.sum("adjust").alias("adjust"))
    return asked.select("id").join(sums, "id", "left").select("id", F.coalesce("adjust", F.lit(0.0)).alias("adjust"))


def lexicon_tiers(entries: DataFrame, forms: list[Column]) -> DataFrame:
    """Words with their derived forms one tier further out; each form's least tier."""
    own = entries.select("word", "tier")
    derived = entries.select(F.explode(F.array(*forms)).alias("word"), (F.col("tier") + 1).alias("tier"))
    return own.unionByName(derived).groupBy("word").agg(F.min("tier").alias("tier"))


def prefixes(words: DataFrame) -> DataFrame:
    """All prefixes of a lexicon: what a walk through it may still be alive on."""
    return words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("word", F.lit(1), i))).alias("prefix")).distinct()


def segmentation_prior(kind: Column, width: Column, height: Column, merge: float = 0.7, split: float = 0.75, ideal: float = 0.45, tolerance: float = 0.35) -> Column:
    excess = F.greatest(F.abs(width / height - ideal) - tolerance, F.lit(0.0)) / tolerance
    return F.when(kind == "merge", -merge).when(kind == "split", -split).otherwise(0.0) - excess


def agreement(identifier: Column, tier: Column, has_lexicon: bool = True) -> Column:
    return F.when(identifier | F.lit(not has_lexicon) | tier.isNotNull(), 1.0).otherwise(0.0)


class Decoder:
    """Beam search over a word's graph of edges, with bigram, lexicon and case terms.

    Hypotheses are ordered by score, then lower class, then earlier cut. A word's edges are one
    group; the tables are bounded by the model and travel with the function.
    """

    def __init__(self, bigrams: dict, lexicon: dict, beam: int = 14, w_match: float = 1.0, bonus: float = 3.44, w_bigram: float = 0.1, w_lex: float = 0.6, w_seg: float = 0.55, case_penalty: float = 3.44, tiers=(1.0, 0.85, 0.7, 0.55, 0.4)):
        self.bigrams, self.lexicon, self.beam = bigrams, lexicon, beam
        self.w_match, self.bonus, self.w_bigram, self.w_lex, self.w_seg = w_match, bonus, w_bigram, w_lex, w_seg
        self.case_penalty, self.tiers = case_penalty, tiers

    def bigram(self, prev: str, next_: str) -> float:
        return self.bigrams.get((prev, next_), FLOOR)

    @staticmethod
    def identifier(text: str) -> bool:
        digits = sum(c.isascii() and c.isdigit() for c in text)
        return len(text) >= 2 and any(c.isalpha() for c in text) and digits >= 0.2 * len(text)

    def anomalies(self, text: str) -> int:
        """Steps from lower or title case to upper case, and from all upper to lower; others reset."""
        state, bad = "", 0
        for c in text:
            if not c.isalpha():
                state = ""
            elif c.isupper():
                bad += state in ("lower", "title")
                state = "initial" if not state else "upper"
            else:
                bad += state == "upper"
                state = "title" if state in ("initial", "title") else "lower"
        return bad

    def paths(self, edges: list[tuple]) -> list[tuple[float, str]]:
        """Complete paths that the beam keeps, with their scores but for the lexicon's and the case's terms."""
        if not edges:
            return []
        start, end = min(e[0] for e in edges), max(e[1] for e in edges)
        best: dict[int, list] = {start: [(0.0, "")]}
        leaving: dict[int, list] = {}
        for e in edges:
            leaving.setdefault(e[0], []).append(e)
        for node in sorted({n for e in edges for n in e[:2]}):
            kept = sorted(set(best.get(node, ())), key=lambda h: (-h[0], h[1]))[: self.beam]
            best[node] = kept
            for score, text in kept:
                for _, to, char, distance, prior in leaving.get(node, ()):
                    step = self.bonus - self.w_match * distance + self.w_bigram * self.bigram(text[-1:], char) + self.w_seg * prior
                    best.setdefault(to, []).append((score + step, text + char))
        return [(score + self.w_bigram * self.bigram(text[-1:], ""), text) for score, text in best.get(end, ())]

    def decode(self, edges: list[tuple]) -> tuple[str | None, float | None]:
        """``edges``: (from, to, character, distance, prior). The best complete path, or nulls."""
        done = []
        for total, text in self.paths(edges):
            if not self.identifier(text):
                tier = self.lexicon.get(text.lower())
                total += self.w_lex * len(text) * self.tiers[min(tier, 5) - 1] if tier else 0.0
                total -= self.case_penalty * self.anomalies(text)
            done.append((-total, text))
        return (min(done)[1], -min(done)[0]) if done else (None, None)


def decode_words(edges: DataFrame, decoder: Decoder, lexicon: DataFrame | None = None) -> DataFrame:
    """One row per word of ``(word, src, dst, ch, d, prior)``: ``word, text, score, identifier``.

    ``lexicon(word, tier)`` may be of any size: the beam's paths, at most ``beam`` for each word, are joined with it. Without
    one, the decoder's own is used.
    """
    kind, alone = dict(edges.dtypes)["word"], lexicon is None
    lattices = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "ch", "d", "prior"))).alias("edges"))
    # decoding costs far more than its rows weigh, so they aren't coalesced by size
    lattices = lattices.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, lattice in enumerate(batch.column("edges").to_pylist()):
                steps = [tuple(e.values()) for e in lattice]
                if alone:
                    text, score = decoder.decode(steps)
                    rows.append((k, text, score, 0.0, bool(text and decoder.identifier(text)), None, 0))
                    continue
                for score, text in decoder.paths(steps) or [(None, None)]:
                    known = bool(text and decoder.identifier(text))
                    rows.append((k, text, score, 0.0 if known or text is None else decoder.case_penalty * decoder.anomalies(text), known, None if known or text is None else text.lower(), len(text or "")))
            at, *columns = zip(*rows) if rows else [[]] * 7
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["word", "text", "score", "penalty", "identifier", "lower", "size"])

    paths = lattices.mapInArrow(run, f"word {kind}, text string, score double, penalty double, identifier boolean, lower string, size int")
    if lexicon is None:
        return paths.select("word", "text", "score", "identifier")
    tiers = F.array(*[F.lit(t) for t in decoder.tiers])
    known = paths.join(lexicon.select(F.col("word").alias("lower"), "tier"), "lower", "left")
    bonus = F.coalesce(decoder.w_lex * F.col("size") * F.element_at(tiers, F.least("tier", F.lit(5))), F.lit(0.0))
    best = F.min(F.struct((-(F.col("score") + bonus - F.col("penalty"))).alias("less"), "text", "identifier"))
    return known.groupBy("word").agg(best.alias("b")).select("word", "b.text", (-F.col("b.less")).alias("score"), "b.identifier")


def probe_reading(edges: DataFrame) -> DataFrame:
    """The cheapest edge out of each node: ``word, src, dst, ch``; ties go to the lower character."""
    best = F.min(F.struct("d", "ch", "dst"))
    return edges.groupBy("word", "src").agg(best.alias("b")).select("word", "src", F.col("b.dst").alias("dst"), F.col("b.ch").alias("ch"))


def apply_overrides(params: DataFrame, overrides: DataFrame) -> DataFrame:
    """All or nothing: the defaults with the overrides, or an error if one names no parameter."""
    known = params.select("name", F.lit(True).alias("known"))
    bad = overrides.join(known, "name", "left").filter("known is null or value is null or isnan(value)").select("name").limit(5).collect()
    if bad:
        raise ValueError("not parameters, or not finite: " + ", ".join(r["name"] for r in bad))
    return params.join(overrides.select("name", F.col("value").alias("new")), "name", "left").select("name", F.coalesce("new", "value").alias("value"), F.col("new").isNotNull().alias("overridden"))


def table_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side whose values differ or are missing."""
    both = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))


def automaton_size(words: DataFrame, word: str = "word") -> DataFrame:
    """States and transitions of the minimal automaton that accepts the words: one row.

    Two prefixes share a state if the same suffixes may follow. Suffix sets are told apart by
    their size and two order-free sums of hashes, so no set is collected; null words are left out.
    """
    w = F.col(word)
    cuts = words.filter(w.isNotNull()).select(w.alias("w")).distinct().select("w", F.explode(F.sequence(F.lit(0), F.length("w"))).alias("i"))
    suffix = F.substr("w", F.col("i") + 1, F.length("w") - F.col("i"))
    sets = cuts.groupBy(F.substr("w", F.lit(1), F.col("i")).alias("prefix")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(suffix)).alias("a"), F.bit_xor(F.xxhash64(suffix, F.lit(1))).alias("b"))
    state = F.struct("n", "a", "b")
    arcs = cuts.filter("i < length(w)").select(F.substr("w", F.lit(1), F.col("i")).alias("prefix"), F.substr("w", F.col("i") + 1, F.lit(1)).alias("next")).distinct()
    states = sets.select(state.alias("s")).distinct().agg(F.count("*").alias("states"))
    transitions = arcs.join(sets, "prefix").select(state.alias("s"), "next").distinct().agg(F.count("*").alias("transitions"))
    return states.join(F.broadcast(transitions))  # one row each


def rule_violations(rules: DataFrame) -> DataFrame:
    """What makes a confusion table invalid: ``a, b, context, violation``, a row for each rule and kind."""
    many = F.count("*").over(Window.partitionBy("a", "b", "context")) > 1
    kinds = F.array(
        F.when(many, "duplicate"), F.when(F.col("a") == F.col("b"), "same class"), F.when(~F.col("favour").isin(F.col("a"), F.col("b")), "favours neither"), F.when(~(F.col("adjust") > 0), "not positive")
    )
    return rules.withColumn("k", kinds).select("a", "b", "context", F.explode(F.array_compact("k")).alias("violation"))
