"""The engine: a prototype bank with settings, applied to tables of glyph vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import confidence, features, matching
from quillspark.operators.pages import page_glyphs

#: Fixed value: a knob that isn't a setting.
GEOMETRY_WEIGHT = "match.geometry_weight"
GEOMETRY = features.DIMS - features.BLOCKS["geometry"][0]

#: Settings and defaults; a name that isn't here is refused.
DEFAULTS = {"match.top_k": 3.0, "confidence.lm_floor": 0.8, "route.matcher_margin": 0.7, "route.net_prob": 0.7, "decode.beam_width": 14.0, "match.classifier": 0.0}


class Engine:
    """``recognize`` gives words, ``recognize_lines`` nested lines, ``probe`` ranked candidates."""

    def __init__(self, bank: DataFrame, network: object | None = None, exclude: str | None = None):
        """``exclude`` names a column of bank and glyphs whose equal values aren't matched with each other."""
        self.bank, self.network, self.exclude = bank, network, exclude
        self.params = dict(DEFAULTS)
        self.weights: list[float] | None = None

    def set_param(self, name: str, value: float) -> None:
        if name not in self.params:
            raise KeyError(name)
        if not math.isfinite(value):
            raise ValueError(f"{name} must be finite")
        self.params[name] = float(value)

    def set_feature_weights(self, weights: list[float]) -> None:
        if not all(math.isfinite(w) and w >= 0 for w in weights):
            raise ValueError("weights must be finite and not negative")
        self.weights = list(weights)

    def classifier_fallback(self) -> str | None:
        """Why the prototypes stand in for a network, or None if it is used."""
        return None if self.network is not None else "no network tables in the model"

    def probe(self, glyphs: DataFrame) -> DataFrame:
        """Ranked candidates per glyph ``(q, vec)`` with distance ratio and confidence."""
        found = matching.class_distances(glyphs.select("q", "vec", *([self.exclude] if self.exclude else [])), self.bank, self.weights, exclude=self.exclude)
        top = matching.top_classes(found, int(self.params["match.top_k"]))
        ratio = matching.ratio(F.col("d1"), F.col("d2"))
        return top.select("q", "class", "rank", "d", confidence.character(ratio).alias("conf"))

    def recognize(self, glyphs: DataFrame) -> DataFrame:
        """One row per word of ``(page, line, word, q, vec)``: text and confidence."""
        best = self.probe(glyphs).filter("rank = 1")
        chars = glyphs.select("page", "line", "word", "q").join(best, "q", "left").withColumn("class", F.coalesce("class", F.lit("?")))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", "class"))), lambda x: x["class"]), "")
        return chars.groupBy("page", "line", "word").agg(text.alias("text"), confidence.geometric_mean(F.coalesce("conf", F.lit(0.0))).alias("conf"), F.count("*").alias("chars"))

    def set_knob(self, name: str, value: float) -> bool:
        """Move one knob by name, as a command line does; False for one that is unknown or refused.

        ``match.geometry_weight`` isn't a setting: it weights the geometry block of the feature vector, the rest by one.
        """
        try:
            if name == GEOMETRY_WEIGHT:
                self.set_feature_weights([1.0] * (features.DIMS - GEOMETRY) + [float(value)] * GEOMETRY)
            else:
                self.set_param(name, value)
        except (KeyError, ValueError):
            return False
        return True

    def recognize_bytes(self, pages: DataFrame) -> DataFrame:
        """Words of ``pages(page, width, height, pixels)``: ``page, line, word, text, conf, chars`` and the word's box.

        The bank holds vectors of ``features.extract``. Pages without ink have no rows.
        """
        found = page_glyphs(pages)
        vectors = found.select("page", "line", "word", "q", features.extract(found, "ink", F.col("x1") - F.col("x0"), "baseline", "x_height").alias("vec"))
        box = found.groupBy("page", "line", "word").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        return self.recognize(vectors).join(box, ["page", "line", "word"])

    def recognize_lines(self, glyphs: DataFrame) -> DataFrame:
        """One row per line with its words nested in order."""
        words = self.recognize(glyphs)
        nested = F.array_sort(F.collect_list(F.struct("word", "text", "conf", "chars")))
        return words.groupBy("page", "line").agg(nested.alias("words"), confidence.geometric_mean(F.col("conf"), F.col("chars")).alias("conf"))
