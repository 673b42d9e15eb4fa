"""Language identification by fusing evidence.

log posterior(l) = text log-likelihood + log P(declared | l) + log P(address suffix | l) + log prior(l | host), normalised.

Text likelihoods are multinomials over hashed byte trigrams, fitted on a bounded labelled sample; a uniform one stands for no
language at all ("und"). As neighbouring trigrams depend on each other, a text's evidence weighs as much as EFFECTIVE of them at
most, on average over all of them. Everything else is counted on all rows by grouped aggregation of text-only posteriors: how
often each language declares what, comes from which suffix, and the host priors, smoothed towards the domain's, which are
smoothed towards the corpus'. A row's own share is taken out of its host's counts.

Two scans of the texts: one for the counts, one for the decision; nothing but counts is shuffled.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import bounded_sample, few, maybe_broadcast, pick, stage, table
from tideline.session import ship_package

#: At most so many labelled documents, and so many bytes of them, are brought to the driver to fit on.
SAMPLE = 2_000
SAMPLE_BYTES = 128 << 20
BINS = 1 << 16
EFFECTIVE = 100.0
#: Weight, in rows, of the broader level when a host's or domain's shares are smoothed.
SMOOTH = 5.0
LEAST = 0.5
UND = "und"


@dataclass
class TextModel:
    languages: list[str]
    logs: bytes  # float32, BINS x languages

    def table(self):
        import numpy as np

        return np.frombuffer(self.logs, np.float32).reshape(BINS, len(self.languages))


def _grams(text: str):
    """Bins of a text's byte trigrams after lower-casing; none for a text without letters."""
    import numpy as np

    if not any(map(str.isalpha, text)):
        return np.empty(0, np.int64)
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit_text(texts: list[str], languages: list[str]) -> TextModel:
    import numpy as np

    names = sorted(set(languages) - {UND})
    logs = np.zeros((BINS, len(names) + 1), np.float32)
    for k, name in enumerate(names):
        n = np.zeros(BINS)
        for t, l in zip(texts, languages, strict=True):
            if l == name:
                n += np.bincount(_grams(t), minlength=BINS)
        logs[:, k] = np.log((n + 0.1) / (n.sum() + 0.1 * BINS))
    logs[:, -1] = -math.log(BINS)
    return TextModel([*names, UND], logs.tobytes())


def fit_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """A text model from at most `sample` distinct rows with a label, and SAMPLE_BYTES of text, chosen by a hash of the row.

    Rows without text or label don't count; without any the model knows no language.
    """
    rows = pick(docs, id_col, text_col, label_col).toDF("id", "text", "label").where("text IS NOT NULL AND label IS NOT NULL")
    some = bounded_sample(rows, ["id", "text", "label"], sample, SAMPLE_BYTES, "text")
    return fit_text([r.text for r in some], [r.label for r in some])


@functools.cache
def _likelihood(model_logs: bytes, n: int):
    import numpy as np

    return np.frombuffer(model_logs, np.float32).reshape(BINS, n)


def text_evidence(model: TextModel, text: Column) -> Column:
    """array<double>: a log-likelihood per language; all 0 for null, empty and letterless texts."""
    logs, n = model.logs, len(model.languages)

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        import numpy as np

        table = _likelihood(logs, n)
        out = []
        for t in texts:
            g = _grams(t or "")
            total = np.zeros(n)
            for i in range(0, len(g), 65536):
                total += table[g[i : i + 65536]].sum(0, dtype=np.float64)
            out.append(total * min(1.0, EFFECTIVE / len(g)) if len(g) else total)
        return pd.Series(out)

    return evidence(text)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body and later projections or filters use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _softmax(logs: Column) -> Column:
    def shares(powers: Column) -> Column:
        return _let(F.aggregate(powers, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(powers, lambda x: x / total))

    return _let(logs, lambda v: _let(F.array_max(v), lambda top: _let(F.transform(v, lambda x: F.exp(x - top)), shares)))


def _sums(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """Per key the rows and the sums of their soft assignments."""
    sums = [F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in range(n)]
    made = rows.groupBy(*key).agg(F.count("*").alias("rows"), *sums)
    return made.select(*key, "rows", F.array(*[f"s{i}" for i in range(n)]).alias("sums"))


def identify(rows: DataFrame, model: TextModel, *, text: Column, declared: Column, suffix: Column, host: Column, domain: Column) -> DataFrame:
    """rows with language, posterior and accepted; columns of these names are replaced, all others stay.

    declared, suffix, host and domain may be null (no evidence of that kind). Texts that are null, empty or without letters, and
    texts that look like none of the languages, are "und". accepted: a language other than und at a posterior of LEAST or more.
    Repeated rows count as often as they occur and fare alike; an empty table gives no rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n = len(model.languages)
    kept = [c for c in rows.columns if c not in ("language", "posterior", "accepted")]
    if n == 1:  # nothing was labelled
        return rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(UND).alias("language"), F.lit(1.0).alias("posterior"), F.lit(False).alias("accepted"))
    primary = F.regexp_extract(F.lower(declared), "^[a-z]{2,3}", 0)
    keys = {"_d": primary, "_s": F.lower(suffix), "_h": host, "_m": domain}
    keys = {k: F.coalesce(v.cast("string"), F.lit("")) for k, v in keys.items()}
    lean = rows.select(*[v.alias(k) for k, v in keys.items()], text_evidence(model, text).alias("logs")).withColumn("soft", _softmax(F.col("logs"))).select(*keys, "soft")
    hosts = _sums(lean, ["_d", "_s", "_m", "_h"], n)  # all later counts are sums of these
    hosts = stage(few(hosts.withColumnRenamed("sums", "soft")), "evidence")

    def up(key: list[str]) -> DataFrame:
        sums = [F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in range(n)]
        return hosts.groupBy(*key).agg(F.sum("rows").alias("rows"), *sums).select(*key, "rows", F.array(*[f"s{i}" for i in range(n)]).alias("sums"))

    whole = up([]).collect()[0]
    if not whole.rows:
        return rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(UND).alias("language"), F.lit(1.0).alias("posterior"), F.lit(False).alias("accepted"))
    total = [max(x, 1e-9) for x in whole["sums"]]
    prior = [(x + 1) / (whole.rows + n) for x in total]

    def given(key: str, name: str) -> DataFrame:
        """log P(value | language), the value's share of all rows as the smoothing prior; without a value there is no evidence."""
        by = up([key])
        logs = [F.when(F.col(key) == "", F.lit(0.0)).otherwise(F.log((F.get("sums", F.lit(i)) + SMOOTH * F.col("rows") / whole.rows) / (total[i] + SMOOTH))) for i in range(n)]
        return by.select(key, F.array(*logs).alias(name))

    d, s = given("_d", "declared_logs"), given("_s", "suffix_logs")
    domain_share = up(["_m"]).select("_m", F.array(*[(F.get("sums", F.lit(i)) + SMOOTH * prior[i]) / (F.col("rows") + SMOOTH) for i in range(n)]).alias("domain_share"))
    host = up(["_m", "_h"]).join(domain_share, "_m").select("_m", "_h", F.col("rows").alias("host_rows"), F.col("sums").alias("host_sums"), "domain_share")
    full = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], *[v.alias(k) for k, v in keys.items()], text_evidence(model, text).alias("logs"))
    for t, key, width in ((d, ["_d"], 256), (s, ["_s"], 256), (host, ["_m", "_h"], 512)):
        full = full.join(maybe_broadcast(t, t.count(), width), key, "left")
    names = F.array(*map(F.lit, model.languages))

    def log_prior(i: int, soft: Column) -> Column:
        share = F.get("domain_share", F.lit(i))
        smoothed = (F.greatest(F.get("host_sums", F.lit(i)) - F.get(soft, F.lit(i)), F.lit(0.0)) + SMOOTH * share) / (F.greatest(F.col("host_rows") - 1, F.lit(0)) + SMOOTH)
        return F.when(F.col("_h") == "", F.log(F.lit(prior[i]))).otherwise(F.log(smoothed))

    def evidence(soft: Column) -> Column:
        return F.array(*[F.get("logs", F.lit(i)) + F.get("declared_logs", F.lit(i)) + F.get("suffix_logs", F.lit(i)) + log_prior(i, soft) for i in range(n)])

    def decision(post: Column) -> Column:
        return _let(F.array_max(post), lambda best: F.struct(F.element_at(names, F.array_position(post, best).cast("int")).alias("language"), best.alias("posterior")))

    silent = F.forall("logs", lambda x: x == 0)
    nothing = F.struct(F.lit(UND).alias("language"), F.lit(1.0).alias("posterior"))
    fused = full.withColumn("_r", F.when(silent, nothing).otherwise(_let(_softmax(F.col("logs")), lambda soft: _let(_softmax(evidence(soft)), decision))))
    decided = fused.select(*[F.col(f"c{i}") for i in range(len(kept))], F.col("_r.language").alias("language"), F.col("_r.posterior").alias("posterior"))
    return decided.withColumn("accepted", (F.col("language") != UND) & (F.col("posterior") >= LEAST)).toDF(*kept, "language", "posterior", "accepted")


_OPEN = re.compile(r"<(script|style)\b", re.ASCII | re.IGNORECASE)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.ASCII | re.IGNORECASE) for name in ("script", "style")}
_ENTITY = re.compile(r"&#?\w{1,31};", re.ASCII)


def page_text(html: str) -> str:
    """A page's text: without scripts, styles, comments, tags and entities; a < that nothing closes stays.

    One pass, linear in the page: an end that is not found once is not looked for again.
    """
    parts, at, missing = [], 0, set()

    def end_of(what: str, found: int) -> int:
        if found < 0:
            missing.add(what)
        return found

    while (start := html.find("<", at)) >= 0:
        parts.append(html[at:start])
        at = -1
        opened = _OPEN.match(html, start)
        if opened and (name := opened.group(1).lower()) not in missing:
            closed = _CLOSE[name].search(html, opened.end())
            at = end_of(name, closed.end() if closed else -1)
        if at < 0 and html.startswith("<!--", start) and "--" not in missing:
            closed = end_of("--", html.find("-->", start + 4))
            at = closed + 3 if closed >= 0 else -1
        if at < 0:
            at = html.find(">", start + 1) + 1
            if not at:  # scripts and comments end in > as well
                at = start
                break
        parts.append(" ")
    parts.append(html[at:])
    return _ENTITY.sub(" ", "".join(parts))


def visible_text(html: Column) -> Column:
    """page_text() of a column; null stays null."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(page_text, na_action="ignore")

    return text(html)


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """identify() over columns url and html: the html tag's lang attribute, the address' last label, host and registered domain.

    Null pages have no text, null addresses are no evidence; repeated rows fare alike. Pages of any length take linear time.
    """
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    domain = F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise("")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^<>]*\blang\s*=\s*["']?([a-z]+)""", 1)
    return identify(pages, model, text=visible_text(F.col("html")), declared=declared, suffix=F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1), host=host, domain=domain)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_language(table(spark, sf_dir, "documents"))
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return identify_pages(pages, model).select("page_id", "language", "posterior", "accepted")
