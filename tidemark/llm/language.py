"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, keyed, sample_key, staged, without_rows

BUCKETS = 1 << 15
#: ASCII characters other than letters are spaces here.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, of letters and word ends only."""
    body = b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "
    if len(body) < 3:
        return np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(body, np.uint8).astype(np.uint32)
    code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(17)
    return np.bincount(code, minlength=BUCKETS)


@dataclass
class TextModel:
    """Multinomial likelihoods of trigrams by language."""

    languages: list[str]
    logs: np.ndarray  # (bucket, language)


def language_code(column: Column | str) -> Column:
    """A declared language in lower case without region or script (en-US and EN_gb are en, fil isn't fi); null where nothing is left."""
    bare = F.substring_index(F.translate(F.lower(F.trim(column)), "_", "-"), "-", 1)
    return F.nullif(F.trim(bare), F.lit(""))


def train(docs: DataFrame, most_texts: int = 1000, most_chars: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> TextModel:
    """A text model of every label that any row has, however few rows that are.

    Labels are counted over all rows; the trigrams are those of at most most_texts rows of each label (those of
    least MD5 of id and text), and of the first most_chars characters of each. Of a label with more rows only those under a bound
    that about 4 * most_texts of them pass are sent on, and each label is counted in a task of its own.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(sample_key(id_col, text_col).alias("k"), F.substring(text_col, 1, most_chars).alias("text"), language_code(label_col).alias("label"))
    rows = rows.where("label is not null")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") <= 4 * most_texts, "g").otherwise(F.lower(F.lpad(F.hex((4.0 * most_texts / F.col("n") * 0xFFFFFFFF).cast("long")), 8, "0")))  # "g" is above all digits
    some = rows.join(F.broadcast(sizes.select("label", bound.alias("bound"))), "label").where("k < bound").drop("bound")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("k", "text"))
    some = some.withColumn("rank", rank).where(F.col("rank") <= most_texts).select("label", "text")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((trigrams(t) for t in rows["text"]), np.zeros(BUCKETS, np.int64))
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    counts = {r.label: np.frombuffer(r.counts, "<i8") for r in some.groupBy("label").applyInPandas(count, "label string, counts binary").toLocalIterator()}
    languages = sorted(counts)
    if not languages:
        return TextModel([], np.zeros((BUCKETS, 0)))
    table = np.stack([counts[k] for k in languages], axis=1)
    shares = table / np.maximum(1, table.sum(axis=0))
    # A tenth comes from what all languages share, whatever the size of a label's sample: a trigram that is new to two languages
    # speaks for neither, and the likelihoods of a label with few rows aren't flattened by smoothing.
    common = (shares.mean(axis=1, keepdims=True) + 1 / BUCKETS) / 2
    return TextModel(languages, np.log(0.9 * shares + 0.1 * common))


def identify(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text: Column | str = "text", declared: Column | str | None = "lang", host: Column | str | None = "source", suffix: Column | str | None = None, trust: float = 0.9, weight: float = 20.0, least: float = 0.6, unlike: float = 0.05, margin: float = 2.5) -> DataFrame:
    """One row (doc_id, language, confidence, accepted) for each row of docs.

    The posterior of each language is the product of
    - the likelihood of the text's trigrams,
    - the likelihood of the declared language: `trust` if it is that language, the rest shared by the
      others; nothing is said where none or an unknown one is declared,
    - the host's prior: shares of the languages that the text alone votes for on that host, smoothed with `weight` votes towards the
      shares of the address suffix, those towards the shares of all rows, and those towards equal shares. A row's own vote doesn't count.
    Votes are counted by grouped aggregation; a host with most of the rows is pre-aggregated, and its join is one that Spark can split.

    A row is rejected (not accepted) if its text has no letters, is unlike every known language, or if the
    largest posterior is below `least`. A text is unlike all if the mean log-likelihood of its trigrams in the language it
    is likeliest in is more than `margin` (a factor of e ** 2.5 on each trigram) below the quantile `unlike` of the means of all rows with
    20 trigrams or more. Declared languages are compared as whole codes without region (language_code). Null texts are empty and are rejected; null hosts and suffixes are one group each.
    Of equal posteriors the language first in the alphabet is taken. Very long texts are read whole.
    Repeated rows vote each. A null id stays null. An empty table gives an empty result. Other columns aren't read.
    """
    languages = model.languages
    k = len(languages)

    def as_column(x: Column | str | None, kind: str) -> Column:
        return (F.col(x) if isinstance(x, str) else F.lit(None) if x is None else x).cast(kind)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = [], np.zeros((batch.num_rows, k))
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = trigrams(t or "")
                at = np.flatnonzero(own)
                sums[i] = own[at] @ model.logs[at]
                n.append(int(own.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(n, pa.int64()), *(pa.array(sums[:, j]) for j in range(k))], names=["doc_id", "declared", "host", "suffix", "n", *(f"text{j}" for j in range(k))])

    rows = docs.select(as_column(id_col, "long").alias("doc_id"), as_column(text, "string").alias("text"), language_code(as_column(declared, "string")).alias("declared"), as_column(host, "string").alias("host"), as_column(suffix, "string").alias("suffix"))
    if not k:  # nothing to learn from: no language is known
        return rows.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    rows = rows.mapInArrow(likelihoods, ", ".join(["doc_id long, declared string, host string, suffix string, n long", *(f"text{j} double" for j in range(k))]))
    best = F.greatest(*(F.col(f"text{j}") for j in range(k)), F.lit(float("-inf")))
    vote = F.when(F.col("n") > 0, F.coalesce(*(F.when(F.col(f"text{j}") == best, j) for j in range(k))))
    rows = staged(rows.withColumn("vote", vote), "language-text")

    mean = best / F.greatest("n", F.lit(1))
    floor = rows.where("n >= 20").agg(F.percentile_approx(mean, unlike, 10000)).first()[0]
    floor = (-20.0 if floor is None else floor) - margin

    votes = [F.count(F.when(F.col("vote") == j, 1)).alias(f"v{j}") for j in range(k)]
    by_host = staged(rows.groupBy("suffix", "host").agg(*votes), "language-hosts")
    by_suffix = by_host.groupBy("suffix").agg(*(F.sum(f"v{j}").alias(f"s{j}") for j in range(k))).withColumnRenamed("suffix", "_suffix")
    overall = by_host.agg(*(F.coalesce(F.sum(f"v{j}"), F.lit(0)).alias(f"g{j}") for j in range(k))).first()
    hosts = by_host.join(by_suffix, F.col("suffix").eqNullSafe(F.col("_suffix"))).select(F.col("suffix").alias("_suffix"), F.col("host").alias("_host"), *(c for j in range(k) for c in (f"v{j}", f"s{j}")))
    hosts = staged(hosts, "language-priors")

    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_suffix")))
    own = [(F.col("vote").eqNullSafe(F.lit(j))).cast("int") for j in range(k)]
    voted = F.col("vote").isNotNull().cast("int")

    def smoothed(counts: list[Column], parents: list[Column]) -> list[Column]:
        total = sum(counts[1:], counts[0]) - voted
        return [(c - o + weight * p) / (total + weight) for c, o, p in zip(counts, own, parents, strict=True)]

    prior = [F.lit(1.0 / k)] * k
    for level in ([F.lit(int(overall[f"g{j}"])) for j in range(k)], [F.col(f"s{j}") for j in range(k)], [F.col(f"v{j}") for j in range(k)]):
        prior = smoothed(level, prior)
    known = F.coalesce(F.col("declared").isin(*languages), F.lit(False))
    told = [F.when(~known, 0.0).when(F.col("declared") == x, float(np.log(trust))).otherwise(float(np.log((1 - trust) / max(1, k - 1)))) for x in languages]
    logs = joined.select("doc_id", "n", mean.alias("mean"), *((F.col(f"text{j}") + F.log(prior[j]) + told[j]).alias(f"log{j}") for j in range(k)))
    most = F.greatest(*(F.col(f"log{j}") for j in range(k)), F.lit(float("-inf")))
    share = F.lit(1.0) / sum((F.exp(F.col(f"log{j}") - most) for j in range(k)), F.lit(0.0))
    named = F.coalesce(*(F.when(F.col(f"log{j}") == most, F.lit(x)) for j, x in enumerate(languages)))
    found = logs.select("doc_id", named.alias("language"), share.alias("confidence"), "n", "mean")
    return found.select("doc_id", "language", "confidence", ((F.col("n") > 0) & (F.col("mean") >= floor) & (F.col("confidence") >= least)).alias("accepted"))


def keep_identified(docs: DataFrame, model: TextModel, **evidence) -> DataFrame:
    """docs without the rows that identify() rejects. Each row is decided by itself, whatever its id; repeated rows, and rows without an
    id, are rows like all others. Null and empty texts are rejected, very long ones read whole. An empty table stays empty; other columns stay as they are."""
    docs = keyed(docs, "language-rows")
    found = identify(docs, model, ROW, **evidence)
    return without_rows(docs, found.where(~F.col("accepted")).select("doc_id"), "language-gone")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Visible text, declared language, host and address suffix of web pages (page_id, url, html)."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z_-]+)", 1))
    return pages.select("page_id", bare.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.substring_index(host, ".", -1).alias("suffix"))
