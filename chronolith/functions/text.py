"""Text expressions (columns in, columns out) and the few text measures that have none built in."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that tokenising leaves out, and those that key terms leave out.
STOPWORDS = tuple(dict.fromkeys("""
the and a an is in it of to that this for with as on at by from they them their there be been being have has had not no but or so such
what which when where why how can could may might shall should will would i me my mine you your yours he him his she her hers its we our
ours theirs myself yourself himself herself itself ourselves yourselves themselves who whom these those am are was were do does did doing
ought us now then here all any both each few more most other some nor only own same than too very s t just don
""".split()))  # fmt: skip
KEY_STOPWORDS = tuple("""
the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should may might must can
""".split())  # fmt: skip

# What an answer says that abstains.
ABSTENTIONS = ("no information", "not mentioned", "not provided", "don't know", "do not know", "cannot find", "no record")

PUNCTUATION = r"[!-/:-@\[-`{-~]"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_answer(c: Column) -> Column:
    """Commas out, articles and "and" to blanks, punctuation out, lower case, single blanks."""
    c = F.regexp_replace(F.regexp_replace(c, ",", ""), r"(?iU)\b(a|an|the|and)\b", " ")
    return squeeze(F.lower(F.regexp_replace(c, PUNCTUATION, "")))


def normalize_answer_lower_first(c: Column) -> Column:
    """The variant that lowers, takes punctuation out and then the articles."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, ",", "")), PUNCTUATION, ""), r"\b(a|an|the|and)\b", " "))


def normalize_answer_spaced(c: Column) -> Column:
    """The variant that turns punctuation into blanks and drops a, an, the."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, " "), r"\b(a|an|the)\b", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def tokens(c: Column, stopwords=STOPWORDS) -> Column:
    """Lower-cased words of three characters or more that aren't stopwords."""
    return F.filter(words(c), lambda x: (F.length(x) > 2) & ~x.isin(*stopwords))


def key_terms(c: Column, most: int = 15) -> Column:
    return F.slice(F.array_distinct(tokens(c, KEY_STOPWORDS)), 1, most)


def clean_text(c: Column) -> Column:
    """Markup, addresses and phone numbers out, single blanks, then letters, digits and blanks alone."""
    for pattern in (r"<[^>]+>", r"https?://[^\s<>\"]+", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^A-Za-z0-9 ]", ""))


def detect_language(c: Column) -> Column:
    """english if more than half of the characters are ASCII letters, else mixed; unknown without any."""
    letters = F.length(F.regexp_replace(c, "[^a-zA-Z]", ""))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "unknown").when(letters / F.length(c) > 0.5, "english").otherwise("mixed")


def content_hash(c: Column, size: int = 64) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.substring(F.sha2(c, 256), 1, size))


def count_of(c: Column, word: Column) -> Column:
    """How often ``word`` occurs, without overlaps."""
    return (F.length(c) - F.length(F.replace(c, word, F.lit("")))) / F.length(word)


def keyword_relevance(c: Column, keyword: str) -> Column:
    """0.6 frequency, 0.3 position, 0.2 for a whole word; from 0.1 to 1."""
    c, k = F.lower(c), F.lit(keyword.lower())
    n = count_of(c, k)
    size = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    frequency = F.least(F.lit(1.0), n / size * 20)
    position = 1.0 - (F.instr(c, keyword.lower()) - 1) / F.length(c) * 0.3
    whole = F.when(F.concat(F.lit(" "), c, F.lit(" ")).contains(f" {keyword.lower()} "), 0.2).otherwise(0.0)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.1).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), frequency * 0.6 + position * 0.3 + whole)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Token Jaccard, at least 0.85 where one's tokens are among the other's."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")) for c in (a, b))
    both, any_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    share = both / any_
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(both == F.least(F.size(x), F.size(y)), F.greatest(share, F.lit(0.85))).otherwise(share)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of distinct tokens."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when(both == 0, 0.0).otherwise(2 * both / (F.size(x) + F.size(y)))


def once(fields: dict[str, Column], of) -> Column:
    """``of(row)`` of a row with these fields, each worked out once however often ``of`` names it."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])), of), 1)


def multiset_common(a: Column, b: Column) -> Column:
    """The size of the intersection of two token lists as multisets: a walk along both, sorted into one list."""
    tagged = lambda list_, side: F.transform(list_, lambda x: F.struct(x.alias("x"), F.lit(side).alias("side")))
    both = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(s: Column, t: Column) -> Column:
        same, left = s["x"].eqNullSafe(t["x"]), t["side"] == 0
        count = lambda old, here: F.when(same, old).otherwise(0) + F.when(here, 1).otherwise(0)
        return F.struct(t["x"].alias("x"), count(s["a"], left).alias("a"), count(s["b"], ~left).alias("b"), (s["n"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))).alias("n"))

    return F.aggregate(both, start, step, lambda s: s["n"] + F.least(s["a"], s["b"]))


def _f1(common: Column, p: Column, r: Column) -> Column:
    return F.when(common == 0, 0.0).otherwise(2 * (common / F.size(p)) * (common / F.size(r)) / (common / F.size(p) + common / F.size(r)))


def answer_tokens(c: Column) -> Column:
    """The words of a normalised answer."""
    return F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")


def f1_of_tokens(p: Column, r: Column) -> Column:
    """Multiset F1 of two token lists."""
    lists = once({"p": p, "r": r}, lambda x: F.struct(x["p"].alias("p"), x["r"].alias("r"), multiset_common(x["p"], x["r"]).alias("common")))
    return once({"x": lists}, lambda y: _f1(y["x"]["common"], y["x"]["p"], y["x"]["r"]))


def token_f1(prediction: Column, reference: Column) -> Column:
    """Multiset token F1 of normalised answers, without stemming."""
    return f1_of_tokens(answer_tokens(prediction), answer_tokens(reference))


def score_answer(prediction: Column, reference: Column, category: Column) -> Column:
    """Token F1; category 1 averages each reference part's best; category 5 wants an abstention."""
    refused = None
    for phrase in ABSTENTIONS:
        hit = F.lower(prediction).contains(phrase)
        refused = hit if refused is None else refused | hit
    parts = lambda c: F.transform(F.split(c, ","), lambda x: answer_tokens(F.trim(x)))
    best = once({"p": parts(prediction), "r": parts(reference)}, lambda x: F.transform(x["r"], lambda r: F.array_max(F.transform(x["p"], lambda p: F.when(F.arrays_overlap(p, r), f1_of_tokens(p, r)).otherwise(0.0)))))
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(F.split(reference, ","))
    return F.when(category.isin(2, 3, 4), token_f1(prediction, reference)).when(category == 1, mean).when((category == 5) & refused, 1.0).otherwise(0.0)


def dates_in_text(c: Column) -> Column:
    """Sorted distinct ISO dates named in prose: 2026-03-01, Mar 3, 2026 and 3 March 2026."""
    month = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
    iso = F.transform(F.regexp_extract_all(c, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    named = F.regexp_extract_all(F.lower(c), F.lit(rf"\b{month}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"), F.lit(0))
    turned = F.regexp_extract_all(F.lower(c), F.lit(rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{month}\s+\d{{4}}\b"), F.lit(0))
    numbers = "jan=1,feb=2,mar=3,apr=4,may=5,jun=6,jul=7,aug=8,sep=9,oct=10,nov=11,dec=12"
    table = F.str_to_map(F.lit(numbers), F.lit(","), F.lit("="))
    part = lambda x, p, g: F.regexp_extract(x, p, g)
    build = lambda x: F.try_to_date(F.concat_ws("-", part(x, r"(\d{4})$", 1), F.element_at(table, part(x, r"([a-z]{3})[a-z]*\.?\s+(?:\d|\d{4})", 1)), part(x, r"\b(\d{1,2})(?:st|nd|rd|th)?,?\s", 1)), "yyyy-M-d")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(iso, F.transform(named, build), F.transform(turned, build)))))


def strict_check(prediction: Column, accept: Column, grading: Column) -> Column:
    """Whether an accepted answer stands as whole words, or a date is named; null where only a judge applies."""
    p = F.lower(prediction)
    word = F.exists(accept, lambda a: F.rlike(p, F.concat(F.lit(r"(?U)\b\Q"), F.lower(a), F.lit(r"\E\b"))))
    dates = F.transform(dates_in_text(prediction), lambda d: d.cast("string"))
    return F.when(grading == "date_exact", F.arrays_overlap(dates, accept)).when(grading == "exact", word)


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.!?;]"), lambda s: F.trim(s)), lambda s: s != "")


def split_any_sentences(c: Column) -> Column:
    """Sentences by Latin and CJK ends (the ends are left out); blank ones count for nothing."""
    return F.filter(F.transform(F.split(c, "[.!?;\u3002\uff01\uff1f\uff1b\n]"), lambda s: F.trim(s)), lambda s: s != "")


def cjk_estimate(c: Column) -> Column:
    """Words: runs of Latin letters and digits, plus each CJK character."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+|[一-鿿]"), F.lit(0)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of lower-cased texts; 0 if either is null."""
    return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def nfd(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


def _stem(w: str) -> str:
    """Porter's stemmer (1980)."""
    if len(w) <= 2:
        return w
    is_c = lambda s, i: s[i] not in "aeiou" and not (s[i] == "y" and i > 0 and is_c(s, i - 1) is True)
    form = lambda s: "".join("c" if is_c(s, i) else "v" for i in range(len(s)))
    m = lambda s: len(re.findall("v+c+", form(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and is_c(s, len(s) - 1)
    cvc = lambda s: form(s).endswith("cvc") and s[-1] not in "wxy"
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    again = False
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in form(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in form(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and "v" in form(w[:-1]):
        w = w[:-1] + "i"
    two = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    three = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for rules in (two, three):
        for rule in sorted(rules.split(), key=lambda r: -len(r.split(":")[0])):
            end, new = rule.split(":")
            if w.endswith(end):
                if m(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + new
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=lambda e: -len(e)):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if m(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if m(stem) > 1 or m(stem) == 1 and not cvc(stem):
            w = stem
    return w[:-1] if m(w) > 1 and double(w) and w.endswith("l") else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(a: pd.Series) -> pd.Series:
    """Porter stems of a token list."""
    return a.map(lambda xs: None if xs is None else [_stem(x) for x in xs])


def common_subsequence(x, y) -> int:
    """The length of the longest common subsequence, with a bit for each token of ``x`` and one addition for each of ``y``."""
    places: dict = {}
    for i, t in enumerate(x):
        places[t] = places.get(t, 0) | 1 << i
    row = full = (1 << len(x)) - 1
    for t in y:
        if at := places.get(t):
            met = row & at
            row = (row + met | row - met) & full
    return len(x) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F of the longest common subsequence of two token lists; 0 if either is null or empty."""

    def f(x, y):
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        return 2 * common_subsequence(x, y) / (len(x) + len(y))

    return pd.Series([f(x, y) for x, y in zip(a, b)], dtype=float)


def window_split(size: int = 1000, overlap: int = 100):
    """A function of texts that cuts them at sentence ends into overlapping windows."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(a: pd.Series) -> pd.Series:
        def parts(text):
            out, start = [], 0
            while text and start < len(text):
                end = min(len(text), start + size)
                if end < len(text):
                    best = max(text.rfind(c, start + size // 2, end) for c in ".!?")
                    end = best + 1 if best > 0 else end
                piece = text[start:end].strip()
                if piece:
                    out.append(piece)
                if end >= len(text):
                    break
                start = max(end - overlap, start + 1)
            return out

        return a.map(parts)

    return split
