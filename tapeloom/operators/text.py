"""Lexicon scores of texts, and links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.safe import div


def lexicon_score(texts: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """(positive - negative) / hits over the words of each text, each text labelled by a band of a tenth."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]+)"), 1)
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    t = texts.select("doc_id", "source", count(positive).alias("pos"), count(negative).alias("neg"))
    score = div((F.col("pos") - F.col("neg")).cast("double"), F.col("pos") + F.col("neg"), 0.0)
    return t.select("doc_id", "source", "pos", "neg", F.round(score, 6).alias("score"), F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("label"))


def _hits(positive: list[str], negative: list[str], negations: list[str], degrees: dict[str, float], contrasts: tuple[str, ...] = ()) -> Column:
    """The column `words` as hits: 1 or -1, times the degree of the word before, turned by a negation among the three before, and halved and turned by a contrast among the five before."""
    degree = F.create_map(*(F.lit(x) for kv in degrees.items() for x in kv))
    among = lambda i, k, known: F.exists(F.slice("words", F.greatest(F.lit(1), i + 1 - k), F.least(i, F.lit(k))), lambda v: v.isin(*known))

    def hit(word, i):
        own = F.when(word.isin(positive), 1.0).when(word.isin(negative), -1.0).otherwise(0.0)
        ahead = F.when(i > 0, F.coalesce(F.try_element_at(degree, F.get("words", i - 1)), F.lit(1.0))).otherwise(1.0)
        value = own * ahead * F.when(among(i, 3, negations), -1.0).otherwise(1.0)
        if contrasts:
            value = value * F.when(among(i, 5, contrasts), -0.5).otherwise(1.0)
        return F.when(own == 0, 0.0).otherwise(value)

    return F.transform("words", hit)


def _share(hits: Column) -> Column:
    """The sum of hits over the sum of their sizes; 0 without a hit."""
    return div(F.aggregate(hits, F.lit(0.0), lambda a, x: a + x), F.aggregate(hits, F.lit(0.0), lambda a, x: a + F.abs(x)), 0.0)


def modified_score(texts: DataFrame, positive: list[str], negative: list[str], negations: list[str], degrees: dict[str, float], contrasts: tuple[str, ...] = ()) -> DataFrame:
    """Each hit counts 1 or -1, times the degree of the word before it, turned by a negation among the three before it; after a contrast among the five before it, half and turned."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]+)"), 1)
    t = texts.select("doc_id", words.alias("words")).select("doc_id", _hits(positive, negative, negations, degrees, contrasts).alias("hits"))
    return t.select("doc_id", F.round(_share(F.col("hits")), 6).alias("score"), F.size(F.filter("hits", lambda x: x != 0)).alias("hits"))


def news_ensemble(texts: DataFrame, positive: list[str], negative: list[str], negations: list[str], degrees: dict[str, float], contrasts: tuple[str, ...], weights: tuple[float, float, float]) -> DataFrame:
    """Each source's mean score by three scorers (plain counts, modified hits, hits with contrasts), weighted and labelled; the texts are read and split once."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]+)"), 1)
    plain = F.transform("words", lambda w: F.when(w.isin(positive), 1.0).when(w.isin(negative), -1.0).otherwise(0.0))
    made = {"plain": plain, "modified": _hits(positive, negative, negations, degrees), "contrasted": _hits(positive, negative, negations, degrees, contrasts)}
    t = texts.select("source", words.alias("words")).select("source", *(v.alias(k) for k, v in made.items()))
    means = t.select("source", *(F.round(_share(F.col(k)), 6).alias(k) for k in made)).groupBy("source").agg(F.count("*").alias("n_news"), *(F.avg(k).alias(k) for k in made))
    score = sum(w * F.col(k) for k, w in zip(made, weights, strict=True)) / sum(weights)
    return means.select("source", "n_news", score.alias("score"), F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("label"))


def weighted_by_source(scores: DataFrame, weights: dict[str, float], default: float = 0.6) -> DataFrame:
    """The mean score with weights by source and by age (e to the minus a tenth of the age): one pass, summed map-side."""
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")), F.lit(default)) * F.exp(-0.1 * (F.col("doc_id") % 30))
    return scores.agg(F.count("*").alias("n"), F.round(div(F.sum(w * F.col("score")), F.sum(w), 0.0), 5).alias("score"), F.round(F.avg(F.when(F.col("score") > 0.1, 1.0).otherwise(0.0)), 6).alias("positive_share"))


def links(pages: DataFrame) -> DataFrame:
    """Targets of the links on pages, and how many pages have each."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))).alias("href")).groupBy("href").agg(F.count("*").alias("pages"))


def phrase_score(texts: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """Phrases left to right, the longest that fits first, none within another: (positive - negative) / hits."""
    phrases = sorted([*positive, *negative], key=lambda p: (-len(p), p))
    body = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")
    found = F.regexp_extract_all(body, F.lit(r"\b(" + "|".join(phrases) + r")\b"), 1)
    count = lambda known: F.size(F.filter("found", lambda w: w.isin(known)))
    t = texts.select("doc_id", found.alias("found")).select("doc_id", count(positive).alias("pos"), count(negative).alias("neg"))
    return t.select("doc_id", "pos", "neg", F.round(div((F.col("pos") - F.col("neg")).cast("double"), F.col("pos") + F.col("neg"), 0.0), 6).alias("score"))


def sentence_score(texts: DataFrame, positive: list[str], negative: list[str], negation: str, intensifier: str, factor: float = 1.5) -> DataFrame:
    """Each lexicon word once a sentence, turned by a negation and weighed by an intensifier among the letters just before it: total / (2 hits), clipped.

    Sentences are at most as long as their text, and each is looked at where it is.
    """
    ahead = max(len(negation), len(intensifier)) + 1

    def one(sentence):
        def hit(word, sign):
            at = F.instr(sentence, F.lit(word)) if isinstance(word, str) else None
            before = F.substring(sentence, F.greatest(F.lit(1), at - ahead), F.least(F.lit(ahead), at - 1))
            weight = F.when(before.contains(intensifier), factor).otherwise(1.0) * F.when(before.contains(negation), -1.0).otherwise(1.0)
            return F.when(at > 0, sign * weight)

        return F.array_compact(F.array(*(hit(w, 1.0) for w in positive), *(hit(w, -1.0) for w in negative)))

    sentences = F.split(F.lower(F.coalesce("text", F.lit(""))), "[.!?]+")
    hits = texts.select("doc_id", F.flatten(F.transform(sentences, one)).alias("hits"))
    n, total = F.size("hits"), F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), div(total, n * 2.0, 0.0)))
    return hits.select("doc_id", n.alias("hits"), F.round(score, 5).alias("score"), F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("label"))


def document_score(texts: DataFrame, positive: list[str], negative: list[str], negations: list[str], degrees: dict[str, float]) -> DataFrame:
    """Counts of a whole text: any negation swaps the two, the strongest degree multiplies."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]+)"), 1)
    count = lambda known: F.size(F.filter("words", lambda w: w.isin(known)))
    t = texts.select("doc_id", words.alias("words")).select("doc_id", count(positive).alias("p"), count(negative).alias("n"), (count(negations) > 0).alias("turned"), F.greatest(F.lit(1.0), *(F.when(F.array_contains("words", w), d).otherwise(1.0) for w, d in degrees.items())).alias("degree"))
    pos, neg = F.when(F.col("turned"), F.col("n")).otherwise(F.col("p")), F.when(F.col("turned"), F.col("p")).otherwise(F.col("n"))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), div((pos - neg) * F.col("degree"), pos + neg, 0.0)))
    return t.select("doc_id", pos.alias("pos"), neg.alias("neg"), F.round(score, 6).alias("score"), F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral").alias("label"))


def moods(rows: DataFrame) -> DataFrame:
    """An ensemble of two scorers (a, b), and a blend of news, social and technical scores, each with its bands."""
    ensemble = 0.6 * F.col("a") + 0.4 * F.col("b")
    blend = 0.4 * F.col("news") + 0.3 * F.col("social") + 0.3 * F.col("technical")
    return rows.select("doc_id", ensemble.alias("ensemble"), F.when(ensemble > 0.15, "positive").when(ensemble < -0.15, "negative").otherwise("neutral").alias("label"), blend.alias("blend"), F.when(blend > 0.4, "strong_bullish").when(blend > 0.1, "bullish").when(blend > -0.1, "neutral").when(blend > -0.4, "bearish").otherwise("strong_bearish").alias("level"))
