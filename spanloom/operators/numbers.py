"""Numbers said or written in running text, the labels that belong to them, and series made of both.

A spoken number is read by its scale groups; labels meet numbers in a matching of greatest gain that keeps the order of both. What was
said before decides on a repeated number and on a matching, so each text is read by one pass of Python in Arrow batches, in
time that follows its length: only labels within reach of a number are compared. Series and statistics are column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Number words, scales and suffixes; the order of the suffixes decides what is read, so "5 thousand" is five t.
SMALL = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())} | {"fourty": 40}
GREAT = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
SUFFIXES = {"k": 1e3, "m": 1e6, "bn": 1e9, "b": 1e9, "t": 1e12, "%": 1.0, "percent": 1.0, "million": 1e6, "billion": 1e9, "thousand": 1e3, "trillion": 1e12}
ORDINALS = {"first": "Q1", "1st": "Q1", "second": "Q2", "2nd": "Q2", "third": "Q3", "3rd": "Q3", "fourth": "Q4", "4th": "Q4"}
QUARTERS = ORDINALS | {f"q{n}": f"Q{i + 1}" for i, names in enumerate((("1", "one"), ("2", "two"), ("3", "three"), ("4", "four"))) for n in names}
#: Fixed values, in characters: how far a label reaches, what part of it an unmatched one costs, what a distance to a later label counts, how close one number said twice stands, where the currency is looked for.
REACH = 110
UNMATCHED = 0.85
LATER = 0.7
SAME_PLACE = 6
CURRENCY_WITHIN = 90

_small = "|".join([*SMALL, *TENS])
#: White space of any script; digits are 0 to 9.
_space = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = re.compile(_space)
LABEL = re.compile(rf"\b(?:{'|'.join(ORDINALS)}|q[1-4]|quarter{_space}+(?:one|two|three|four|[1-4]))\b", re.I)
#: A number in digits from its first digit on; white space and a currency before it are looked for backwards, so that blanks are read once.
WRITTEN = re.compile(rf"(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+(?:\.[0-9]+)?){_space}*(?:{'|'.join(SUFFIXES)})?", re.I)
DIGITS = re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?")
SUFFIX = re.compile(r"[A-Za-z%]+\Z")
SPOKEN = re.compile(rf"(?<![a-z])(?:{_small})(?![a-z])(?:[^a-z0-9%$]+(?:{_small}|hundred|{'|'.join(GREAT)}|and)(?![a-z]))*", re.I)
SCALE = re.compile(rf"\b({'|'.join(GREAT)})\b")
DOLLARS = re.compile(r"\bdollars?\b")
WORDS = re.compile("[a-z]+")
_fields = [T.StructField("place", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())]
FACTS = T.ArrayType(T.StructType(_fields))
SAID = T.ArrayType(T.StructType([*_fields, T.StructField("label", T.StringType())]))
Fact = tuple[int, float, str]


def spoken_value(said: str) -> float:
    """The number that number words spell: scale words close groups, and within a group each "hundred" multiplies what stands before it.

    A group or hundred without anything before it counts as one. "and" and other words count nothing.
    """
    total = 0.0
    parts = SCALE.split(said.lower())
    for k in range(0, len(parts), 2):
        value = None
        for piece in re.split(r"\bhundred\b", parts[k]):
            simple = float(sum(SMALL.get(w, TENS.get(w, 0)) for w in WORDS.findall(piece)))
            value = simple if value is None else max(value, 1.0) * 100 + simple
        total += max(value, 1.0) * GREAT[parts[k + 1]] if k + 1 < len(parts) else value
    return total


def written_numbers(text: str) -> list[Fact]:
    """(place, value, unit) of numbers in digits, with currency, thousands and suffix; a digit right behind a q belongs to a label."""
    found, last = [], 0
    for m in WRITTEN.finditer(text):
        start = m.start()
        while start > last and SPACES.match(text, start - 1):
            start -= 1
        currency = text[start - 1] if start > last and text[start - 1] in "$€£" else ""
        start -= len(currency)
        last = m.end()
        if start == m.start() and start and text[start - 1] in "qQ":
            continue
        suffix = SUFFIX.search(m[0])
        scale = suffix[0].lower() if suffix else ""
        unit = "%" if scale in ("%", "percent") else currency
        found.append((start, float(DIGITS.match(m[0])[0].replace(",", "")) * SUFFIXES.get(scale, 1.0), unit))
    return found


def spoken_numbers(text: str) -> list[Fact]:
    """(place, value, unit) of numbers in words, without zero; dollars are looked for behind their start."""
    found = []
    for m in SPOKEN.finditer(text):
        value = spoken_value(m[0])
        if value > 0:
            found.append((m.start(), value, "$" if DOLLARS.search(text[m.start() : m.start() + CURRENCY_WITHIN].lower()) else ""))
    return found


def facts_of(text: str) -> list[Fact]:
    """All numbers of a text by place, written ones first; one that repeats an earlier kept one at nearly the same place goes."""
    kept: list[Fact] = []
    for place, _, value, unit in sorted([(p, 0, v, u) for p, v, u in written_numbers(text)] + [(p, 1, v, u) for p, v, u in spoken_numbers(text)]):
        k = len(kept) - 1
        while k >= 0 and place - kept[k][0] < SAME_PLACE and abs(value - kept[k][1]) >= 1e-6:
            k -= 1
        if k < 0 or place - kept[k][0] >= SAME_PLACE:
            kept.append((place, value, unit))
    return kept


def label_name(said: str) -> str:
    return QUARTERS.get(said.lower().replace("quarter ", "q").strip(" ")) or " ".join(w.capitalize() for w in said.split(" "))


def labels_of(text: str, at: list[int]) -> list[str]:
    """A label or '' for each of the places ``at`` (ascending): the matching of greatest gain that keeps the order of labels and places.

    A pair within REACH gains what both cost unmatched, less its distance, which counts LATER if the label follows. Gains are whole
    numbers (tenths of a character), so equal ones are equal; of equal matchings the one whose last labels, then last places, stay free. Of the table of
    best gains with the first labels and places, a label's row is kept for the places within its reach alone: before them it is the row above, behind them constant.
    """
    marks = [(m.start(), m[0]) for m in LABEL.finditer(text)] if at else []
    both, later = round(2 * UNMATCHED * REACH * 10), round(LATER * 10)
    rows: list[tuple[int, list[int]]] = [(0, [0])]  # of each label: the number of places before its row, and the best gains from there on

    def best(i: int, j: int) -> int:
        while i and j < rows[i][0]:
            i -= 1
        first, gains = rows[i]
        return gains[min(j - first, len(gains) - 1)]

    for i, (place, _) in enumerate(marks):
        low, high = bisect_left(at, place - REACH), bisect_right(at, place + REACH)
        gains = [best(i, low)]
        for j in range(low, high):
            gap = abs(place - at[j])
            gains.append(max(gains[-1], best(i, j + 1), best(i, j) + both - gap * (later if place >= at[j] else 10)))
        rows.append((low, gains))
    out, i, j = [""] * len(at), len(marks), len(at)
    while i and j:
        here = best(i, j)
        if j <= rows[i][0] or here == best(i - 1, j):
            i -= 1
        elif here == best(i, j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            out[j] = label_name(marks[i][1])
    return out


@F.pandas_udf(FACTS)
def number_facts(texts: pd.Series) -> pd.Series:
    """All numbers of a text as (place, value, unit); see facts_of. A null text has none."""
    return pd.Series([[{"place": p, "value": v, "unit": u} for p, v, u in facts_of(t or "")] for t in texts])


@F.pandas_udf(T.ArrayType(T.StringType()))
def matched_labels(texts: pd.Series, at: pd.Series) -> pd.Series:
    """A label or '' for each of the places of a text; see labels_of."""
    return pd.Series([labels_of(t or "", [int(x) for x in a]) for t, a in zip(texts, at, strict=True)])


@F.pandas_udf(SAID)
def labelled_numbers(texts: pd.Series) -> pd.Series:
    def read(text: str) -> list[dict]:
        facts = facts_of(text)
        return [{"place": p, "value": v, "unit": u, "label": label} for (p, v, u), label in zip(facts, labels_of(text, [f[0] for f in facts]), strict=True)]

    return pd.Series([read(t or "") for t in texts])


@F.pandas_udf(FACTS)
def numbers_in_digits(texts: pd.Series) -> pd.Series:
    """The numbers of a text that are written in digits as (place, value, unit); see written_numbers. A null text has none."""
    return pd.Series([[{"place": p, "value": v, "unit": u} for p, v, u in written_numbers(t or "")] for t in texts])


def extract_numbers(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """id, place, value, unit, label of every number in a text; null texts have none. One narrow pass."""
    # most texts say no number at all: a plain pattern keeps them on the JVM
    said = df.select(F.col(row_id), F.col(text).cast("string").alias("__text")).where(F.col("__text").rlike(rf"(?i)[0-9]|{_small}"))
    return said.select(row_id, F.explode(labelled_numbers("__text")).alias("x")).select(row_id, "x.place", "x.value", "x.unit", "x.label")


def build_series(facts: DataFrame, row_id: str, least: int = 2) -> DataFrame:
    """id, labels, values, unit: labelled facts where there are two, else all; within twelve times of the upper median; the first of each label, in order."""
    every = W.partitionBy(row_id)
    labelled = F.count_if(F.col("label") != "").over(every)
    pool = facts.withColumn("__l", labelled).where((F.col("__l") < least) | (F.col("label") != ""))
    # sorted once per row, not once per number
    values = pool.groupBy(row_id).agg(F.array_sort(F.collect_list("value")).alias("__s")).select(F.col(row_id).alias("__r"), F.size("__s").alias("__n"), F.element_at("__s", (F.floor(F.size("__s") / 2) + 1).cast("int")).alias("__middle"))
    pool = pool.join(values, F.col(row_id).eqNullSafe(F.col("__r"))).drop("__r")
    middle = F.col("__middle")
    kept = pool.where((F.col("__n") >= least) & (F.col("value") >= middle / 12) & (F.col("value") <= middle * 12))
    order = every.orderBy("place", "value")
    kept = kept.withColumn("__k", F.row_number().over(order)).withColumn("name", F.when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit("#"), F.col("__k").cast("string"))))
    unit = F.min_by("unit", F.when(F.col("unit") != "", F.col("__k")))
    firsts = kept.withColumn("__u", unit.over(every)).withColumn("__m", F.count(F.lit(1)).over(every)).where(F.col("__m") >= least)
    firsts = firsts.groupBy(row_id, "name").agg(F.min("place").alias("place"), F.min_by("value", "__k").alias("value"), F.first("__u").alias("u"))
    points = F.array_sort(F.collect_list(F.struct("place", "name", "value")))
    out = firsts.groupBy(row_id).agg(points.alias("p"), F.first("u").alias("unit"))
    return out.select(row_id, F.transform("p", lambda x: x["name"]).alias("labels"), F.transform("p", lambda x: x["value"]).alias("values"), F.coalesce("unit", F.lit("")).alias("unit"))


def series_statistics(series: DataFrame, row_id: str) -> DataFrame:
    """id, deltas, growth, overall, cagr (percent), total, mean of each series of two values or more."""
    v, n = F.col("values"), F.size("values")
    pairs = lambda f: F.zip_with(F.slice(v, 1, n - 1), F.slice(v, 2, n - 1), f)
    first, last = F.element_at(v, 1), F.element_at(v, -1)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    growth = lambda a, b: F.when(a == 0, float("inf")).otherwise(F.round((b - a) / a * 100, 4))
    cagr = F.when((first > 0) & (last > 0), F.round((F.pow(last / first, 1.0 / (n - 1)) - 1) * 100, 4))
    return series.where(n >= 2).select(row_id, pairs(lambda a, b: F.round(b - a, 4)).alias("deltas"), pairs(growth).alias("growth"), growth(first, last).alias("overall"), cagr.alias("cagr"), F.round(total, 4).alias("total"), F.round(total / n, 4).alias("mean"))
