"""Language ID: Bayesian fusion of text, declared language, address suffix and hierarchical host priors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Bound of the fit: labelled texts of each language. More languages than a model can hold are refused, none is left out.
#: The text model has so many slots for hashed byte trigrams.
MOST_TEXTS, MOST_LANGUAGES, SLOTS = 3000, 1000, 1 << 16
#: How far a trigram counts as evidence of its own, the longest text's evidence in trigrams, and the prior counts that a level lends the next.
TEMPER, MOST_EVIDENCE, LENT = 0.3, 400, 8.0
#: A row is rejected if its best language has less than this, or its text is less likely than noise under every language.
LEAST_POSTERIOR = 0.5

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[c for c in range(128) if not chr(c).isalpha()]] = 32
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")  # what isn't closed goes to the end
_TAG = re.compile(r"<[^<>]*>")  # a tag ends before the next one begins, so no text is read twice
_ROOT = re.compile(r"(?i)<html\b([^>]*)")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def trigrams(text: str | None) -> np.ndarray:
    """Slots of the trigrams of a text's lower-cased letters as bytes, all else one blank."""
    raw = _KEEP[np.frombuffer((" " + (text or "").lower() + " ").encode(), np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    mixed = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(16)).astype(np.int64)


def plain(markup: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup or "")))


def declared(markup: str | None) -> str | None:
    """The language that the first root element with one declares, wherever it stands outside comments and scripts."""
    for root in _ROOT.finditer(_HIDDEN.sub(" ", markup or "")):
        if m := _LANG.search(root[1]):
            return m[1].lower()
    return None


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.logs = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * SLOTS)).astype(np.float32)

    def evidence(self, text: str | None) -> tuple[list[float], float]:
        """Tempered log-likelihoods by language, and the best one for a trigram over that of noise."""
        at = trigrams(text)
        if not len(at):
            return [0.0] * len(self.languages), -1.0
        mean = np.array([row[at].mean() for row in self.logs], np.float64)
        return (mean * (min(len(at), MOST_EVIDENCE) * TEMPER)).tolist(), float(mean.max() + np.log(SLOTS))


def fitted(labelled: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """The text model from at most MOST_TEXTS labelled texts of each language, taken by a hash of the row's id."""
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.where(F.col(lang).isNotNull() & (F.col(text) != ""))
    rows = {r[lang]: r.n for r in known.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(rows)
    told = spark.createDataFrame([(x, i, min(1.0, 1.1 * MOST_TEXTS / rows[x])) for i, x in enumerate(languages)], "known string, l int, share double")
    chance = F.xxhash64("doc_id" if "doc_id" in labelled.columns else text)
    near = known.join(F.broadcast(told), F.col(lang) == F.col("known")).where(F.pmod(chance, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    first = Window.partitionBy("l").orderBy(F.col("chance"), F.col("text"))
    few = near.select("l", F.col(text).cast("string").alias("text"), chance.alias("chance")).withColumn("no", F.row_number().over(first)).where(F.col("no") <= MOST_TEXTS).select("l", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((max(1, len(languages)), SLOTS), np.int64)
        for b in batches:
            for l, t in zip(b.column(0).to_pylist(), b.column(1)):
                n[l] += np.bincount(trigrams(t.as_py()), minlength=SLOTS)
        l, s = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), pa.array(s, pa.int32()), pa.array(n[l, s], pa.int64())], ["l", "slot", "n"])

    counts = np.zeros((max(1, len(languages)), SLOTS))
    got = few.mapInArrow(count, "l int, slot int, n long").groupBy("l", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts[got["l"].to_numpy(np.int64), got["slot"].to_numpy(np.int64)] = got["n"]
    return TextModel(languages or ["und"], counts)


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, its last two labels and its last label of a URL; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return host, F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1), F.lit(""))


def evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """rows (id, text, given, ...) with texts replaced by logs (array), over_noise and declared."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c not in ("text", "given")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs, over, said = [], [], []
            for x, g in zip(b.column("text"), b.column("given")):
                text = x.as_py()
                said.append((declared(text) if markup else None) or g.as_py())
                got = held.value.evidence(plain(text) if markup else text)
                logs.append(got[0])
                over.append(got[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(logs, pa.list_(pa.float64())), pa.array(over, pa.float64()), pa.array(said, pa.string())], [*rest, "logs", "over_noise", "declared"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", logs array<double>, over_noise double, declared string")


def identify(rows: DataFrame, model: TextModel, markup: bool = False) -> DataFrame:
    """id, lang, posterior, text_lang, declared, rejected for rows (id, text, given, host, domain, suffix).

    A row's text votes for its likeliest language. Grouped votes give, with LENT prior votes from the level above:
    the whole's shares, the domain's given those, the host's given the domain's (a row's own vote taken out), and how
    often each language goes with a declaration and with a suffix. The posterior multiplies the host's prior, both
    likelihoods and the tempered text likelihood. Missing declarations, suffixes and hosts are no evidence. Rejected
    are rows with no letters, with texts less likely than noise under every language, or with a best posterior under
    LEAST_POSTERIOR; text_lang is null where a text has no vote. Null texts are empty, ties go to the first language by
    code point, ids may repeat or be null. Whole texts and whole markup are read, however long. An empty table gives no
    rows, and other columns than those named are not read.
    """
    size = len(model.languages)
    names = F.array(*[F.lit(x) for x in model.languages])
    seen = written(evidence(rows, model, markup).withColumn("vote", F.when(F.col("over_noise") > 0, F.array_position("logs", F.array_max("logs")).cast("int"))), "evidence")
    votes = lambda: [F.sum((F.col("vote") == i + 1).cast("long")).alias(f"n{i}") for i in range(size)]
    shares = lambda: F.array(*[F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("double") for i in range(size)])
    voted = seen.where("vote IS NOT NULL")
    total = voted.agg(*votes()).first()
    n = np.array([total[i] or 0 for i in range(size)], np.float64)
    base = (n + 1) / (n.sum() + size)
    whole = F.array(*[F.lit(float(x)) for x in base])
    by = {k: voted.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"{k}_")).agg(*votes()).select(f"{k}_", shares().alias(f"{k}_n")) for k in ("domain", "host", "declared", "suffix")}
    own = F.transform(names, lambda x, i: (i + 1 == F.coalesce("vote", F.lit(0))).cast("double"))
    joined = seen
    for k, table in by.items():
        apart = F.coalesce(k, F.concat(F.lit("\0"), F.xxhash64("id", "logs").cast("string")))  # rows without one don't meet in one task
        joined = joined.join(table, apart == F.col(f"{k}_"), "left").drop(f"{k}_")
    joined = joined.withColumn("own", own)
    none = F.array_repeat(F.lit(0.0), size)
    less = lambda k: F.zip_with(F.coalesce(f"{k}_n", none), "own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda votes_, prior: F.zip_with(votes_, prior, lambda v, p: (v + p * LENT) / (sum_(votes_) + LENT))
    prior = joined.withColumn("dn", F.when(F.col("domain").isNotNull(), less("domain")).otherwise(none)).withColumn("hn", F.when(F.col("host").isNotNull(), less("host")).otherwise(none))
    prior = prior.withColumn("p_domain", smooth(F.col("dn"), whole)).withColumn("p_host", smooth(F.col("hn"), F.col("p_domain")))
    like = lambda k: F.when(F.col(f"{k}_n").isNotNull(), F.transform(F.zip_with(smooth(less(k), whole), whole, lambda v, p: v / p), lambda x: F.log(x))).otherwise(none)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = prior.withColumn("z", add(add(F.transform("p_host", lambda x: F.log(x)), "logs"), add(like("declared"), like("suffix"))))
    fused = fused.withColumn("top", F.array_max("z"))
    fused = fused.withColumn("posterior", 1 / sum_(F.transform("z", lambda x: F.exp(x - F.col("top")))))
    best = F.element_at(names, F.array_position("z", F.col("top")).cast("int"))
    rejected = (F.col("over_noise") <= 0) | (F.col("posterior") < LEAST_POSTERIOR)
    return fused.select("id", F.when(rejected, F.lit("und")).otherwise(best).alias("lang"), "posterior", F.element_at(names, F.col("vote")).alias("text_lang"), "declared", rejected.alias("rejected"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id with identify()'s columns, for pages (page_id, url, html) and labelled texts (text, lang)."""
    host, domain, suffix = host_parts(F.col("url"))
    rows = pages.select(F.col("page_id").alias("id"), F.col("html").cast("string").alias("text"), F.lit(None).cast("string").alias("given"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    return identify(rows, fitted(labelled), markup=True).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id with identify()'s columns, for documents whose lang is their declaration and whose source stands for a host."""
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("given"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"))
    return identify(rows, fitted(labelled if labelled is not None else docs)).withColumnRenamed("id", "doc_id")
