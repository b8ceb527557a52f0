"""Grounding of answers in sources, claims, errors, calibration, citations, domains."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Markers, opposites, stop words and lexicons of the rule-based detectors; callers may pass their own.
OVERCLAIM = ("always", "never", "definitely", "certainly", "absolutely", "100%", "guaranteed", "proven", "확실히", "반드시", "절대로")
OPPOSITES = (("is not", "is"), ("are not", "are"), ("was not", "was"), ("doesn't", "does"), ("didn't", "did"), ("cannot", "can"), ("isn't", "is"), ("아니", "맞"), ("없", "있"))
CLAIM_OPPOSITES = (("not", "is"), ("no", "yes"), ("never", "always"), ("없", "있"), ("아니", "맞"))
MISS_STOP = (
    "the", "a", "an", "is", "are", "was", "were", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "shall", "can", "need", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "through",
)
CLAIM_STOP = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "이", "가", "을", "를", "의", "에", "에서", "로", "으로", "와", "과")
SUPPORT_STOP = ("the", "a", "an", "is", "are", "was", "were", "be", "have", "has", "had", "do", "does", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "this", "that", "these", "those", "it", "its")
ABSOLUTE = ("always", "never", "all", "none", "every", "must")
LEXICONS = {
    "medical": ("진단", "치료", "환자", "증상", "질병", "약물", "수술", "혈액", "diagnosis", "treatment", "patient", "symptom", "disease", "drug", "의료", "임상", "병원", "의사", "간호", "검사", "처방", "예후", "snomed", "icd", "의공학", "생체", "biomedical", "clinical"),
    "legal": ("법률", "조항", "규정", "계약", "소송", "판결", "법원", "변호사", "legal", "law", "regulation", "contract", "lawsuit", "court", "조례", "헌법", "민법", "형법", "상법", "특허", "저작권"),
    "technical": ("시스템", "알고리즘", "프로그램", "데이터", "네트워크", "서버", "system", "algorithm", "program", "data", "network", "server", "api", "프로토콜", "아키텍처", "모듈", "인터페이스", "구현", "반도체", "회로", "전자", "hardware", "software"),
    "academic": ("연구", "논문", "실험", "결과", "가설", "분석", "방법론", "research", "paper", "experiment", "result", "hypothesis", "학술", "학위", "교육과정", "학점", "교과목", "수업"),
    "financial": ("재무", "회계", "투자", "수익", "비용", "자산", "부채", "financial", "accounting", "investment", "revenue", "cost", "주식", "채권", "펀드", "금리", "환율", "세금", "재무제표", "손익", "현금흐름", "대차대조표", "포트폴리오"),
    "regulatory": ("규제", "인증", "표준", "준수", "감사", "검토", "승인", "regulatory", "certification", "standard", "compliance", "iso", "fda", "ce", "인허가", "심사", "요건"),
}
_W = r"[\p{L}\p{N}_]"
_UNITS = "(?:억|만|천|백|개|년|월|일)?"
# A number between word borders; the first form takes the borders in, for engines without look-around.
HAS_NUMBER = rf"(?:^|[^\p{{L}}\p{{N}}_])[0-9]+(?:\.[0-9]+)?(?:%{_W}|{_UNITS}(?:[^\p{{L}}\p{{N}}_]|$))"
NUMBER = rf"(?<!{_W})[0-9]+(?:\.[0-9]+)?(?:%(?={_W})|{_UNITS}(?!{_W}))"
DATE = r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{4}년\s*[0-9]{1,2}월|[0-9]{1,2}월\s*[0-9]{1,2}일"
NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
ENTITY = rf"(?:^|[^가-힣]){NAME}"
CITATION = r"\[[0-9]+\]|\[[^\]]*p\.?\s*[0-9]+[^\]]*\]|\((?:Source|source):[^)]*\)"


def _share(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def sentence_confidence(rows: DataFrame) -> DataFrame:
    """Adds confidence to (sentence, source): 1 if verbatim, else 0.6 of the largest signal and 0.4 of their mean, within 0.35 and 1.

    What lambdas refer to are columns of an earlier projection, so that it is computed once a row.
    """
    kept = rows.columns
    prep = rows.withColumns({"_s": F.lower("sentence"), "_t": F.lower("source")})
    prep = prep.withColumns({"_w": T.words("_s"), "_x": T.words("_t"), "_p": T.char_windows("_s")})
    grams = {f"_{side}{n}": T.word_ngrams(F.col(c), n) for side, c in (("w", "_w"), ("x", "_x")) for n in (2, 3)}
    prep = prep.withColumns({"_v": F.array_distinct("_x"), **grams})
    w, v, t = F.col("_w"), F.col("_v"), F.col("_t")
    weight = lambda x: F.when(x.rlike("[0-9]"), 2.5).when(F.length(x) > 8, 2.0).when(F.length(x) > 5, 1.5).otherwise(1.0)
    total = lambda a: F.aggregate(F.transform(a, weight), F.lit(0.0), lambda x, y: x + y)
    words = F.when(F.size(w) > 0, total(F.filter(w, lambda x: F.array_contains(v, x))) / total(w)).otherwise(0.0)
    share = lambda n, k: F.nullif(F.least(F.lit(1.0), k * _share(F.array_distinct(f"_w{n}"), F.col(f"_x{n}"))), F.lit(0.0))
    chunk = F.when(F.size("_p") > 0, F.nullif(F.size(F.filter("_p", lambda p: F.contains(t, p))) / F.size("_p"), F.lit(0.0)))
    cited = F.when(F.col("sentence").rlike(CITATION), 0.85)
    prep = prep.withColumn("_g", F.array_compact(F.array(cited, words, words, share(2, 1.2), share(3, 1.5), chunk)))
    mean = F.aggregate("_g", F.lit(0.0), lambda x, y: x + y) / F.size("_g")
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.35), 0.6 * F.array_max("_g") + 0.4 * mean))
    verbatim = F.contains(t, F.trim("_s"))
    return prep.select(*kept, F.round(F.when(verbatim, 1.0).otherwise(conf), 6).alias("confidence"))


def ground(answers: DataFrame, least: float = 0.5, shortest: int = 10) -> DataFrame:
    """(answer_id, i, sentence, confidence, grounded) for answers (answer_id, answer, source); shorter sentences are skipped."""
    rows = answers.select("answer_id", "source", F.posexplode(T.sentences("answer")).alias("i", "sentence")).where(F.length("sentence") >= shortest)
    return sentence_confidence(rows).drop("source").withColumn("grounded", F.col("confidence") >= least)


def verdicts(grounded: DataFrame, overall: float = 0.6, warn: float = 0.4) -> DataFrame:
    """Mean confidence of each answer, whether it is reliable, how many sentences are not grounded, whether to warn, and a label."""
    agg = grounded.groupBy("answer_id").agg(F.round(F.avg("confidence"), 3).alias("confidence"), F.count("*").alias("n_sentences"), F.count(F.when(~F.col("grounded"), 1)).alias("n_ungrounded"))
    label = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "good").when(F.col("confidence") >= 0.5, "partial").otherwise("low")
    return agg.withColumns({"reliable": F.col("confidence") >= overall, "warn": F.col("n_ungrounded") >= warn * F.col("n_sentences"), "label": label})


def claims(answers: DataFrame, shortest: int = 10) -> DataFrame:
    """(answer_id, i, claim, kind): sentences of `shortest` characters or more as claims; a number wins over a date, that over a name."""
    parts = F.filter(F.transform(F.split("answer", r"[.!?]\s+|[。！？]"), lambda x: F.trim(x)), lambda x: F.length(x) >= shortest)
    kind = F.when(F.col("claim").rlike(HAS_NUMBER), "number").when(F.col("claim").rlike(DATE), "temporal").when(F.col("claim").rlike(ENTITY), "entity").otherwise("fact")
    return answers.select("answer_id", F.posexplode(parts).alias("i", "claim")).withColumn("kind", kind)


def _without(tokens: Column, stop: tuple[str, ...]) -> Column:
    return F.array_distinct(F.filter(tokens, lambda x: ~x.isin(*stop)))


def verify_claims(found: DataFrame, sources: DataFrame, least: float = 0.4) -> DataFrame:
    """Adds support (share of the claim's words of three letters or more in the source), verified and error to claims of sources (answer_id, source).

    A claim without such words is verified, one with a number or a name that the source holds too; a
    number claim that holds none needs half its words. error names what is wrong with the others.
    """
    w, v = _without(T.words(F.col("claim"), 2), CLAIM_STOP), T.words(F.col("source"), 2)
    j = found.join(sources, "answer_id").withColumns({"_w": w, "_v": v}).withColumn("support", F.round(_share(F.col("_w"), F.col("_v")), 6))
    c, low, kind = F.col("source"), F.lower("source"), F.col("kind")
    number = F.exists(F.regexp_extract_all("claim", F.lit(NUMBER), F.lit(0)), lambda x: F.contains(c, x))
    name = F.exists(F.regexp_extract_all("claim", F.lit(ENTITY), F.lit(0)), lambda x: F.contains(low, F.lower(x)))
    good = (
        F.when(F.size("_w") == 0, True).when((kind == "number") & number, True).when((kind == "number") & (F.col("support") < 0.5), False)
        .when((kind == "entity") & name, True).otherwise(F.col("support") >= least)
    )
    against = F.exists(_pairs(CLAIM_OPPOSITES), lambda x: F.contains(F.lower("claim"), x["n"]) & F.contains(low, x["p"]))
    error = F.when(against, "contradictory").when(kind == "number", "quantitative_error").when(kind == "temporal", "temporal_error").when(kind == "entity", "fabricated_entity").otherwise("unsupported_claim")
    return j.withColumn("verified", good).withColumn("error", F.when(~F.col("verified"), error)).drop("source", "_w", "_v")


def _pairs(some: tuple[tuple[str, str], ...]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in some])


def fidelity(verified: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, n_claims, n_grounded, groundedness): the share of an answer's claims that hold; 1 without claims."""
    per = verified.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count(F.when(F.col("verified"), 1)).alias("n_grounded"))
    n, g = F.coalesce("n_claims", F.lit(0)), F.coalesce("n_grounded", F.lit(0))
    return answers.select("answer_id").join(per, "answer_id", "left").select("answer_id", n.alias("n_claims"), g.alias("n_grounded"), F.round(F.when(n > 0, g / n).otherwise(1.0), 6).alias("groundedness"))


def fidelity_summary(per_answer: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and deviation of groundedness, the rate of what is not grounded, and counts; by system, if named."""
    return per_answer.groupBy(*by).agg(
        F.count("*").alias("n_answers"), F.sum("n_claims").alias("n_claims"), F.sum("n_grounded").alias("n_grounded"), F.round(F.avg("groundedness"), 6).alias("groundedness"),
        F.round(F.coalesce(F.stddev_samp("groundedness"), F.lit(0.0)), 6).alias("deviation"), F.round(1.0 - F.avg("groundedness"), 6).alias("hallucination_rate"),
    )


def claim_support(answers: DataFrame, shortest: int = 16) -> DataFrame:
    """(answer_id, i, support, grade, severity) of the longer claims of answers (answer_id, answer, source) by white-space words; severity by what a claim asserts."""
    found = claims(answers, shortest).join(answers.select("answer_id", "source"), "answer_id")
    w = _without(T.white_space_tokens("claim"), SUPPORT_STOP)
    rows = found.withColumn("_w", w).withColumn("support", F.when(F.size("_w") == 0, 1.0).otherwise(F.round(_share(F.col("_w"), T.white_space_tokens("source")), 6)))
    grade = F.when(F.col("support") >= 0.5, "full").when(F.col("support") >= 0.3, "partial").otherwise("unsupported")
    bold = F.exists(F.array(*map(F.lit, ABSOLUTE)), lambda x: F.contains(F.lower("claim"), x))
    severity = F.when(F.col("claim").rlike(r"[0-9]|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), "high").when(bold, "medium").otherwise("low")
    return rows.select("answer_id", "i", "support", grade.alias("grade"), severity.alias("severity"))


def hallucination_rates(supported: DataFrame, confidences: DataFrame) -> DataFrame:
    """One row over all answers with a confidence (answer_id, confidence): claims, unsupported ones, rates, and their correlation with confidence (0 where it is undefined)."""
    per = supported.groupBy("answer_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("grade") == "unsupported", 1)).alias("bad"))
    j = confidences.join(per, "answer_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "bad": F.coalesce("bad", F.lit(0))}).withColumn("share", F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0))
    steady = (F.min("share") == F.max("share")) | (F.min("confidence") == F.max("confidence"))
    return j.agg(
        F.count("*").alias("n_answers"), F.sum("n").alias("n_claims"), F.sum("bad").alias("n_unsupported"), F.round(F.when(F.sum("n") > 0, F.sum("bad") / F.sum("n")).otherwise(0.0), 6).alias("hallucination_rate"),
        F.count(F.when(F.col("share") > 0, 1)).alias("n_affected"), F.round(F.avg((F.col("share") > 0).cast("double")), 6).alias("answer_rate"), F.round(F.avg("share"), 6).alias("mean_score"),
        F.round(F.when(steady, 0.0).otherwise(F.corr("confidence", "share")), 6).alias("correlation"),
    )


def errors(answers: DataFrame) -> DataFrame:
    """(answer_id, category, severity) of answers (answer_id, answer, reference, context): retrieval miss, hallucination, overclaim, contradiction; an answer may have several."""
    ref, ctx = _without(T.white_space_tokens("reference"), MISS_STOP), T.white_space_tokens("context")
    a, c = F.lower("answer"), F.lower("context")
    miss = (F.size(ref) > 0) & (F.size(F.array_intersect(ref, ctx)) / F.size(ref) < 0.3)
    lacks = lambda p, n: F.exists(F.regexp_extract_all("answer", F.lit(p), F.lit(0)), lambda x: (F.length(x) > n) & ~F.contains(F.col("context"), x))
    claim = F.exists(F.array(*map(F.lit, OVERCLAIM)), lambda m: F.contains(a, m) & ~F.contains(c, m))
    against = F.exists(_pairs(OPPOSITES), lambda x: F.contains(a, x["n"]) & F.contains(c, x["p"]))
    kinds = (("retrieval_miss", miss, "critical"), ("hallucination", lacks(NUMBER, 1) | lacks(NAME, 3), "major"), ("overclaim", claim, "minor"), ("contradiction", against, "critical"))
    found = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(k).alias("category"), F.lit(s).alias("severity"))) for k, x, s in kinds]))
    return answers.select("answer_id", F.explode(found).alias("e")).select("answer_id", "e.category", "e.severity")


def recommendations(found: DataFrame, calibrated: DataFrame, rates: DataFrame, mean_confidence: DataFrame) -> DataFrame:
    """(ord, advice) for errors, one calibration row (ece, accuracy), one row of hallucination_rates and one of (confidence); by fixed rules."""
    n = found.agg(F.count(F.when(F.col("category") == "retrieval_miss", 1)).alias("miss"), F.count(F.when(F.col("category") == "hallucination", 1)).alias("made_up"))
    row = n.crossJoin(F.broadcast(calibrated.select("ece", "accuracy"))).crossJoin(F.broadcast(rates.select("hallucination_rate", "correlation"))).crossJoin(F.broadcast(mean_confidence.select("confidence")))
    rules = (
        (F.col("miss") > 0, "widen retrieval"), (F.col("made_up") > 0, "ground generation"), (F.col("ece") > 0.1, "scale temperature"), (F.col("confidence") > F.col("accuracy") + 0.1, "recalibrate overconfidence"),
        (F.col("hallucination_rate") > 0.2, "verify against context"), (F.col("correlation") < -0.3, "filter by confidence"),
    )
    found = F.array_compact(F.array(*[F.when(x, F.lit(t)) for x, t in rules]))
    return row.select(F.posexplode(found).alias("ord", "advice"))


def cited_windows(answers: DataFrame, sources: DataFrame, around: int = 100, least: float = 0.3) -> DataFrame:
    """(answer_id, citation, place, overlap, valid): citations [n] or (Source: x) and whether the text within `around` characters shares more than `least` of its longer words with the source (citation, source) named.

    Offsets need the places of matches, which columns do not give: an Arrow-batched function finds them.
    """
    pattern = re.compile(r"\[(\d+)\]|\((?:Source|출처|참고):\s*([^)]+)\)")

    @F.pandas_udf("array<struct<citation:string,place:int,around:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(m[1] or m[2], m.start(), t[max(0, m.start() - around) : m.start() + around]) for m in pattern.finditer(t or "")])

    rows = answers.select("answer_id", F.explode(found("answer")).alias("c")).select("answer_id", "c.citation", "c.place", "c.around")
    j = rows.join(sources.select("citation", "source"), "citation", "left")
    w = F.array_distinct(T.words("around", 3))
    overlap = F.when(F.col("source").isNotNull() & (F.size(w) > 0), _share(w, T.words("source", 3))).otherwise(0.0)
    return j.select("answer_id", "citation", "place", F.round(overlap, 6).alias("overlap")).withColumn("valid", F.col("overlap") > least)


def answer_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, ord, citation): "name, p.n" out of three ways to write it, else whatever stands in brackets; each once, in order."""
    ways = (
        r"(?i)\[([^\]]+?),\s*p\.([0-9]+(?:-[0-9]+)?(?:,\s*p\.[0-9]+(?:-[0-9]+)?)*)\]", r"(?i)\[([^\]]+?)\s*-?\s*(?:Sec|Section)\s*[0-9.]+,?\s*(?:Pg?|Page)\.?\s*([0-9]+(?:-[0-9]+)?)\]",
        r"(?i)\[([^\]]+?),\s*(?:페이지|쪽)\s*([0-9]+(?:-[0-9]+)?)\]",
    )
    each = [F.zip_with(F.regexp_extract_all("answer", F.lit(p), F.lit(1)), F.regexp_extract_all("answer", F.lit(p), F.lit(2)), lambda d, n: F.concat(F.trim(d), F.lit(", p."), F.trim(n))) for p in ways]
    named = F.concat(*each)
    rest = F.filter(F.transform(F.regexp_extract_all("answer", F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return answers.select("answer_id", F.posexplode(F.array_distinct(F.when(F.size(named) > 0, named).otherwise(rest))).alias("ord", "citation"))


def page_citation_rate(answers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of answers that cite a page; by system, if named."""
    return answers.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("answer").rlike(r"(?i)p\.?\s*[0-9]+").cast("double")), 6).alias("citation_rate"))


def comparison_sections(answers: DataFrame) -> DataFrame:
    """(answer_id, has_comparison, commonalities, differences) of answers with numbered headings, or a table as differences."""
    part = lambda n, head: F.nullif(F.trim(F.regexp_extract("answer", rf"(?is)\*\*{n}\.\s*(?:{head}).*?\*\*(.+?)(?:\*\*{n + 1}\.|📚|$)", 1)), F.lit(""))
    table = F.nullif(F.regexp_extract("answer", r"(?s)(\|[^\n]*\|[^\n]*\|[^\n]*\n\|[-:]+\|[-:]+\|[-:]+\|.*)", 1), F.lit(""))
    rows = answers.select("answer_id", part(1, "공통점|commonalit").alias("commonalities"), part(2, "차이점|difference").alias("d"), table.alias("t"))
    rows = rows.withColumn("differences", F.coalesce("d", F.when(F.col("commonalities").isNull(), F.col("t"))))
    return rows.select("answer_id", (F.col("commonalities").isNotNull() | F.col("differences").isNotNull()).alias("has_comparison"), "commonalities", "differences")


def error_matrix(found: DataFrame) -> DataFrame:
    """Counts by category and severity with totals (nulls)."""
    return found.rollup("category", "severity").agg(F.count("*").alias("n_errors"))


def error_crosstab(found: DataFrame, severities: tuple[str, ...] = ("critical", "major", "minor")) -> DataFrame:
    """A row for each category, a column for each severity."""
    return found.groupBy("category").pivot("severity", list(severities)).agg(F.count(F.lit(1))).select("category", *[F.coalesce(s, F.lit(0)).alias(s) for s in severities])


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap) of rows (confidence, correct); the last bin is closed."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    agg = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))
    return agg.withColumn("gap", F.round(F.abs(F.col("confidence") - F.col("accuracy")), 6))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, accuracy, Brier score, expected and largest calibration error."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    y = F.col("correct").cast("double")
    per = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(y).alias("a"), F.sum(F.pow(F.col("confidence") - y, F.lit(2.0))).alias("sq"))
    gap = F.abs(F.col("c") - F.col("a"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum("a") / F.sum("n"), 6).alias("accuracy"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"), F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap / F.col("n")), 6).alias("mce"))


def temperature(scored: DataFrame, steps: int = 50) -> DataFrame:
    """One row: the temperature of 0.1, 0.2, ... with the least mean log loss (the first of equals)."""
    grid = scored.sparkSession.range(1, steps + 1).select((F.col("id") / 10.0).alias("t"))
    c = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("confidence")))
    z = F.log(c / (1.0 - c))
    rows = scored.select(z.alias("z"), F.col("correct").cast("double").alias("y")).crossJoin(F.broadcast(grid))
    p = 1.0 / (1.0 + F.exp(-F.col("z") / F.col("t")))
    p = F.least(F.lit(0.999999), F.greatest(F.lit(0.000001), p))
    loss = rows.groupBy("t").agg(F.round(-F.avg(F.col("y") * F.log(p) + (1.0 - F.col("y")) * F.log(1.0 - p)), 9).alias("nll"))
    return loss.orderBy("nll", "t").limit(1)


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, citation): distinct citations of each answer."""
    return answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(0)))).alias("citation"))


def citation_accuracy(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and f1 of cited (key, c) against gold (key, c); keys without gold are left out."""
    c, g = cited.select("key", "c").distinct(), gold.select("key", "c").distinct()
    hit = c.join(g, ["key", "c"]).groupBy("key").agg(F.count("*").alias("h"))
    j = g.groupBy("key").agg(F.count("*").alias("g")).join(c.groupBy("key").agg(F.count("*").alias("n")), "key", "left").join(hit, "key", "left")
    h = F.coalesce(F.col("h"), F.lit(0))
    p, r = F.when(F.col("n") > 0, h / F.col("n")).otherwise(0.0), h / F.col("g")
    return j.select("key", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def section_citation_f1(found: DataFrame, expected: DataFrame) -> DataFrame:
    """F1 of found sections (key, f) against expected ones (key, e), where an ancestor or descendant matches too."""
    from .tree import related_sections

    f, e = found.distinct(), expected.distinct()
    pairs = related_sections(f, e)
    right = pairs.groupBy("key").agg(F.countDistinct("f").alias("fr"), F.countDistinct("e").alias("er"))
    j = e.groupBy("key").agg(F.count("*").alias("ne")).join(f.groupBy("key").agg(F.count("*").alias("nf")), "key", "left").join(right, "key", "left")
    p, r = F.coalesce(F.col("fr") / F.col("nf"), F.lit(0.0)), F.coalesce(F.col("er") / F.col("ne"), F.lit(0.0))
    return j.select("key", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def faithfulness(answers: DataFrame, contexts: DataFrame, least: float = 0.5) -> DataFrame:
    """(answer_id, faithfulness, faithful, n_low): the mean over sentences of the best share of words that some context (answer_id, context) covers; 1 without sentences. n_low: sentences under `least`."""
    s = answers.select("answer_id", F.posexplode(T.sentences("answer", r"\.")).alias("i", "sentence"))
    j = s.join(contexts, "answer_id", "left")
    w = F.array_distinct(T.white_space_tokens("sentence"))
    per = j.groupBy("answer_id", "i").agg(F.max(F.coalesce(_share(w, T.white_space_tokens("context")), F.lit(0.0))).alias("best"))
    mean = per.groupBy("answer_id").agg(F.avg("best").alias("m"), F.count(F.when(F.col("best") < least, 1)).alias("k"))
    score = F.coalesce("m", F.lit(1.0))
    return answers.select("answer_id").join(mean, "answer_id", "left").select("answer_id", F.round(score, 6).alias("faithfulness"), (F.round(score, 6) >= least).alias("faithful"), F.coalesce("k", F.lit(0)).alias("n_low"))


def domains(docs: DataFrame, lexicons: dict[str, tuple[str, ...]] = LEXICONS) -> DataFrame:
    """(doc_id, domain, confidence): the lexicon with most keywords found as substrings, the first of equals; under 0.3 of all: general; none at all: general with 0.5."""
    t = F.lower("text")
    counts = [F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w))) for ws in lexicons.values()]
    rows = docs.select("doc_id", F.array(*counts).alias("c")).withColumns({"total": F.aggregate("c", F.lit(0), lambda x, y: x + y), "best": F.array_max("c")})
    name = F.element_at(F.array(*map(F.lit, lexicons)), F.array_position("c", F.col("best")).cast("int"))
    share = F.when(F.col("total") > 0, F.col("best") / F.col("total")).otherwise(0.0)
    general = (share < 0.3) | (F.col("total") == 0)
    return rows.select("doc_id", F.when(general, "general").otherwise(name).alias("domain"), F.round(F.when(F.col("total") == 0, 0.5).when(general, share).otherwise(F.least(F.lit(1.0), share + 0.3)), 6).alias("confidence"))
