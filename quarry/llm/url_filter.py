"""URL filter by a character language-model ratio (native).

Rules on host and path decide the urls they fit. They also label them: allowed urls train one smoothed variable-order
Markov model, blocked urls another. A url without a rule is judged by the difference of the models' log-likelihoods
over its length, against a threshold that was calibrated on labelled urls which trained neither model.

A url is modelled by its form: host and path, A-Z lower-cased, digits folded to 0, anything outside printable ASCII to
``~``. Each distinct form counts once a class, so a host with a third of all urls does not outweigh the rest, and it is
scored once. Contexts are up to ORDER characters; order k is interpolated with order k - 1 by Witten-Bell smoothing,
and a context that a class has seen fewer than LEAST times hands over to the shorter one. Counts of lower orders are
sums of the highest order's, so the texts are taken apart once. The log ratio of a (context, character) is rounded to
2**-20 and summed as an integer: the result does not depend on the order of rows.

The threshold is the lower edge of the score bin that minimises the sum of both error rates on the forms held out
(one in HELD by hash); the least such bin. Without held-out forms of both classes it is 0.

All is DataFrame operations. Tables of characters and contexts are bounded by the alphabet (96 characters), forms are
aggregated before they are shuffled, and the join back is by form, whose other side has one row a form.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule, has no score and is
blocked. An empty host and path with ``://`` is scored by its end mark alone. Rows are judged apart, so repeated rows
and null ids need nothing special. A very long url is scored whole, in work that grows with its length. Without any
labelled url every score is 0, and all are allowed. Empty input gives an empty result. Only the id and url columns are
read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import discard, materialize, small

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Characters of the longest context, times a class must have seen one, the share of forms held out, bins a unit of score.
ORDER, LEAST, HELD, BINS = 4, 2, 5, 64
ALPHABET, UNIT = 96, float(1 << 20)
START, END = "\x02", "\x03"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    return lower_ascii(F.regexp_extract(u, URL, 1)), F.regexp_extract(u, URL, 2)


def rule_columns(rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def form_of(host: str = "host", path: str = "path") -> Column:
    folded = F.translate(lower_ascii(F.concat(host, path)), string.digits, "0" * 10)
    return F.regexp_replace(folded, r"[^\x20-\x7E]", "~")


def held_out(form: str = "form", held: int = HELD) -> Column:
    return F.conv(F.substring(F.md5(F.col(form)), 1, 8), 16, 10).cast("long") % held == 0


def _grams(form: str, order: int) -> Column:
    """Every window of order + 1 characters of a padded form; linear in its length."""
    return F.regexp_extract_all(F.concat(F.lit(START * order), F.col(form), F.lit(END)), F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))


def log_ratios(forms: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(form, allowed, blocked) to (gram, ratio): log of the models' ratio for each gram's last character, in units.

    Grams of all forms are listed, also those that no training form has. Discarding the result discards their counts.
    """
    counts = forms.select(F.explode(_grams("form", order)).alias("gram"), "allowed", "blocked")
    counts = materialize(counts.groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "url-grams")
    levels = [counts]
    for _ in range(order):
        levels.append(levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    model = None
    for level in reversed(levels):
        context = Window.partitionBy(F.expr("left(gram, length(gram) - 1)"))
        level = level.withColumn("shorter", F.expr("substring(gram, 2)"))
        for x in ("allowed", "blocked"):
            level = level.withColumn(f"{x}_n", F.sum(x).over(context)).withColumn(f"{x}_d", F.sum((F.col(x) > 0).cast("long")).over(context))
        if model is None:
            level = level.withColumns({f"{x}_below": F.lit(1.0 / ALPHABET) for x in ("allowed", "blocked")})
        else:
            level = level.join(model.select(F.col("gram").alias("shorter"), F.col("allowed_p").alias("allowed_below"), F.col("blocked_p").alias("blocked_below")), "shorter")
        model = level.select(
            "gram",
            *[
                F.when(F.col(f"{x}_n") >= least, (F.col(x) + F.col(f"{x}_d") * F.col(f"{x}_below")) / (F.col(f"{x}_n") + F.col(f"{x}_d"))).otherwise(F.col(f"{x}_below")).alias(f"{x}_p")
                for x in ("allowed", "blocked")
            ],
        )
    out = model.select("gram", F.round((F.log("allowed_p") - F.log("blocked_p")) * UNIT).cast("long").alias("ratio"))
    out._quarry_path = counts._quarry_path
    return out


def score_forms(forms: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """(number, form) to (form, score): the mean log ratio of its characters. Characters go by a form's number, not the
    form itself, so that a long one is not sent with each of them."""
    parts = forms.select("number", F.explode(_grams("form", order)).alias("gram")).join(ratios, "gram")
    scores = parts.groupBy("number").agg((F.sum("ratio") / F.lit(UNIT) / F.count("*")).alias("score"))
    return forms.select("number", "form").join(scores, "number").select("form", "score")


def calibrate(scored: DataFrame) -> float:
    """The threshold from (score, allowed, blocked) of held-out forms; its table has a row a bin."""
    bins = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    by_bin, everything = Window.orderBy("bin"), Window.partitionBy()
    below = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    loss = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(everything) + F.sum("b").over(by_bin.rowsBetween(0, Window.unboundedFollowing)) / F.sum("b").over(everything)
    has_both = (F.sum("a").over(everything) > 0) & (F.sum("b").over(everything) > 0)
    best = bins.withColumn("loss", F.when(has_both, loss)).where("loss IS NOT NULL").agg(F.min(F.struct("loss", "bin")).alias("best")).first()["best"]
    return best["bin"] / BINS if best else 0.0


def judge_urls(pages: DataFrame, rules: tuple = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, score, verdict."""
    host, path = host_and_path(url)
    usable = F.coalesce(F.contains(F.col(url), F.lit("://")), F.lit(False))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), usable.alias("usable"))
    rule, says = rule_columns(rules)
    parsed = parsed.withColumn("rule", rule).withColumn("says", says).withColumn("form", F.when(F.col("usable"), form_of()))
    forms = parsed.where("usable").groupBy("form").agg(F.max(F.coalesce(F.col("says") == "allow", F.lit(False)).cast("long")).alias("allowed"), F.max(F.coalesce(F.col("says") == "block", F.lit(False)).cast("long")).alias("blocked"))
    forms = materialize(forms.withColumn("held", held_out()).withColumn("number", F.monotonically_increasing_id()), "url-forms")
    training = forms.select("form", *[F.when(F.col("held"), 0).otherwise(F.col(x)).cast("long").alias(x) for x in ("allowed", "blocked")])
    ratios = log_ratios(training)
    scored = materialize(score_forms(forms, ratios), "url-scores")
    threshold = calibrate(forms.where("held AND allowed + blocked > 0").join(scored, "form"))
    discard(ratios, forms)
    method = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    out = parsed.join(small(scored), "form", "left")
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce("says", method).alias("verdict"))
