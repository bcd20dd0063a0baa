"""Texts that end before what their source published did.

Whole values are cut artificially, as transfers and field limits cut them, and a hashed logistic
regression learns cut from whole by closing characters, words and punctuation and by the length against
the source's limits. It is fitted on a bounded sample, whose own values stand for whole ones: first
without those at a limit and without knowing of limits, then again without those the fit before found
cut. Then every row is scored.

Limits are read off the whole table: lengths at which a source has far more different values than at
the lengths around. A value at a limit that ends like a whole one is whole.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.maxent import fit
from evidra.session import materialize

DIM = 1 << 17
#: About this many rows are taken for the fit, each once as it is and once cut; never more than 1.5 times as many.
TRAIN_ROWS = 24_000
#: What a field limit puts behind a text, and codes of a page that a transfer may stop inside.
MARKS = ["…", "…", "...", "...", " …", " ...", " [...]", "[…]"]
CODES = ["&amp;", "&quot;", "&#x27;", "&lt;", "<br>", "</p>", "\\u2019"]
#: The forms that values have, looked for in this order: cells ``key=value; key=value``, a title and its host, cells between bars; all else is prose.
FORMS = [("rows", r"(?s)^[^|]+ \| [^|=;]{1,40}=[^;]*;"), ("news", r"(?s)^.+ \| [a-z0-9-]+(\.[a-z0-9-]+)+$"), ("cells", r"(?s)^[^|]+ \| [^|]+ \| ")]
#: A feature seen less often than this in the fit counts as unknown; each place in the feature list has a weight for that.
KNOWN_FROM = 4


def _form(e: Column) -> Column:
    kind = F.lit("prose")
    for name, rx in reversed(FORMS):
        kind = F.when(e.rlike(rx), name).otherwise(kind)
    return kind


def source_forms(rows: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(form_src, form): the form that most values of a source have; a row per source. Null sources have none: their values each have their own."""
    n = rows.where(F.col(source_col).isNotNull() & F.col(text_col).rlike(r"\S")).groupBy(F.col(source_col).alias("form_src"), _form(F.col(text_col)).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("form_src").agg(F.max(F.struct("n", "form")).alias("m")).select("form_src", "m.form")


def shaped(rows: DataFrame, id_col: str, text_col: str, source_col: str, forms: DataFrame) -> DataFrame:
    """(id, src, e, kind, title, tail): the value and, for a title with its host, both. Null and blank values are dropped.

    A cut value has lost its form, so the form is its source's.
    """
    df = rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.col(text_col).alias("e")).where(F.col("e").rlike(r"\S"))
    df = df.join(forms, F.col("src") == F.col("form_src"), "left")
    return _parts(df.select("id", F.coalesce("src", F.lit("")).alias("src"), "e", F.coalesce("form", _form(F.col("e"))).alias("kind")))


def _parts(df: DataFrame) -> DataFrame:
    news = F.col("kind") == "news"
    at = F.regexp_extract("e", r"(?s)^(.*) \| [^|]*$", 1)
    return df.withColumn("title", F.when(news, F.when(at != "", at).otherwise(F.col("e"))).otherwise("")).withColumn("tail", F.when(news & (at != ""), F.substring_index("e", " | ", -1)).otherwise(""))


def limits(df: DataFrame, *, surprise: float = 14.0, times: float = 4.0) -> DataFrame:
    """(src, part, len): lengths of values (part 0) or titles (part 1) with far more different values than lengths near them.

    Against the mean ``m`` of the 16 lengths 5 to 12 away, a count ``n`` must be above ``times`` as great, and
    by Chernoff's bound for Poisson counts less likely than exp(-``surprise``). So a source of a few rows can
    have a limit too. Over all rows; only counts by source and length are shuffled on.
    """
    lens = df.select("src", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.length("e").alias("len"), F.xxhash64("e").alias("h")), F.struct(F.lit(1).alias("part"), F.length("title").alias("len"), F.xxhash64("title").alias("h")))).alias("x")).select("src", "x.*").where("len > 0")
    n = lens.groupBy("src", "part", "len", "h").agg(F.lit(1).alias("o")).groupBy("src", "part", "len").agg(F.count("o").alias("n"))
    near = n.select("src", "part", F.explode(F.sequence(F.col("len") - 12, F.col("len") + 12)).alias("len"), F.col("n").alias("m"), F.col("len").alias("from")).where(F.abs(F.col("len") - F.col("from")) > 4)
    around = near.groupBy("src", "part", "len").agg(F.sum("m").alias("m"))
    m = (F.coalesce("m", F.lit(0)) + 0.5) / 16
    odd = F.col("n") * F.log(F.col("n") / m) - F.col("n") + m
    return n.join(around, ["src", "part", "len"], "left").where((F.col("n") > times * m) & (odd > surprise)).select("src", "part", "len")


def with_limits(df: DataFrame, lim: DataFrame) -> DataFrame:
    """Adds whether the value and the title have a limit's length. The limits are few, by length per source; Spark sizes the join."""
    v = lim.where("part = 0").select(F.col("src").alias("s0"), F.col("len").alias("l0"))
    t = lim.where("part = 1").select(F.col("src").alias("s1"), F.col("len").alias("l1"))
    df = df.join(v, (F.col("src") == F.col("s0")) & (F.length("e") == F.col("l0")), "left").join(t, (F.col("src") == F.col("s1")) & (F.length("title") == F.col("l1")), "left")
    return df.withColumn("at_e", F.col("l0").isNotNull()).withColumn("at_t", F.col("l1").isNotNull()).drop("s0", "l0", "s1", "l1")


_NUMBER = re.compile(r"9+(?:[.,]9+)*")
_DIGITS = str.maketrans("0123456789", "9" * 10)
_ENDED = re.compile(r"[.!?。！？।॥۔؟։።;][\"')”’»」）\]]*\s*\Z")
_MARK = re.compile(r"(\s?\[?(?:\.{3}|…)\]?)\s*\Z")
_SCRAP = re.compile(r"(?:&[#a-z0-9]{0,7}|</?[a-z]{0,6}|\\u?[0-9a-f]{0,3}|�)\Z")
_CELL = re.compile(r"; | \| ")
#: So many groups of features a cache of a task holds before it starts anew.
CACHED = 1 << 17
Group = tuple[int, ...]


def _group(*names: str) -> Group:
    return tuple(1 + zlib.crc32(x.encode("utf-8", "replace")) % (DIM - 1) for x in names)


def _mark_of(t: str) -> str:
    m = _MARK.search(t[-7:])
    return m.group(1) if m else ""


@lru_cache(CACHED)
def _last_characters(p: str, end: str) -> tuple[Group, str, str]:
    """Of the last nine characters: their features, the mark there, whether they end a sentence."""
    t = end.lower().translate(_DIGITS)
    cls = "".join("A" if x.isupper() else "a" if x.islower() else "9" if x.isdigit() else x for x in end[-5:])
    mark, ended, scrap = _mark_of(t), "T" if _ENDED.search(t[-8:]) else "N", _SCRAP.search(t)
    names = [f"{p}1|{t[-1:]}", f"{p}2|{t[-2:]}", f"{p}3|{t[-3:]}", f"{p}5|{t[-5:]}", f"{p}c|{cls}", f"{p}d|{cls[-2:]}", f"{p}M|{mark}", f"{p}s|{t[-1:].isspace()}", f"{p}g|{scrap.group() if scrap else ''}", f"{p}h|{scrap.group()[0] if scrap else ''}"]
    return _group(*names), mark, ended


@lru_cache(CACHED)
def _last_words(p: str, mark: str, *raw: str) -> Group:
    """Of the last three words and what stands before a mark."""
    words = [_NUMBER.sub("9", w.lower().translate(_DIGITS)) for w in raw]
    last, before = words[-1] if words else "", ""
    if mark:
        before = last.rstrip(".…[]") or (words[-2] if len(words) > 1 else "")
    return _group(f"{p}w|{last}", f"{p}x|{' '.join(words[-2:])}", f"{p}y|{' '.join(words)}", f"{p}m|{mark}|{before}")


@lru_cache(CACHED)
def _some(*names: str) -> Group:
    return _group(*names)


def _closing(p: str, c: str, at: bool) -> list[Group]:
    """What the end of ``c`` looks like; ``at``: it has the length of a limit."""
    chars, mark, ended = _last_characters(p, c[-9:])
    sign = lambda a, b: (x > y) - (x < y) if (x := c.count(a)) != (y := c.count(b)) else 0
    odd = f"{c.count('"') % 2}{sign('(', ')')}{sign('“', '”')}{sign('«', '»')}{sign('「', '」')}"
    return [chars, _last_words(p, mark, *c.rsplit(None, 3)[-3:]), _some(f"{p}T|{ended}|{at}", f"{p}u|{odd}|{ended}")]


def feature_groups(e: str, k: str, at_e: bool, at_t: bool) -> list[Group]:
    """Indices of a value's features in groups that repeat from value to value; their number tells the kind, their place what they are."""
    end = _closing(f"e{k}|", e, at_e)
    if k == "news":
        title, sep, tail = e.rpartition(" | ")
        if not sep:
            title, tail = e, ""
        return [*end, *_closing(f"t{k}|", title, at_t), _some(f"l|{tail.rpartition('.')[2]}|{tail == ''}", f"L|{tail}", f"tm|{at_t}|{_mark_of(title)}")]
    if k == "prose":
        return end
    parts = _CELL.split(e)
    cell = parts[-1].lower().translate(_DIGITS)
    key, is_pair, _ = cell.partition("=")
    word = cell.split(" ")
    field = key + is_pair if k == "rows" else ""
    names = [f"kf|{k}|{field}", f"lf|{k}|{cell}", f"np|{k}|{min(6, e.count(' | '))}", f"cs|{k}|{len(word[-1])}|{' '.join(word[-2:])}"]
    if k == "cells":
        names.append(f"ct|{re.split('[0-9]', cell)[0]}")
    return [*end, _some(*names)]


def feature_list(e: str, k: str, at_e: bool, at_t: bool) -> list[int]:
    return [i for g in feature_groups(e, k, at_e, at_t) for i in g]


def cut(e: str, k: str, rnd: random.Random) -> tuple[str, bool, bool]:
    """``e`` cut somewhere or (news) in its title, with or without what cuts leave behind; whether at a limit of the value, of the title.

    A part of the cuts counts as made by a limit: features know a limit only by that.
    """
    title, sep, tail = e.rpartition(" | ")
    if k == "news" and sep and len(title) > 14 and rnd.random() < 0.55:
        mark = "" if rnd.random() < 0.25 else rnd.choice(["…", "...", " ..."])
        return f"{title[: rnd.randrange(12, len(title))]}{mark} | {tail}", False, rnd.random() < 0.7
    limited, how = rnd.random() < 0.4, rnd.random()
    left = "" if how < 0.5 else rnd.choice(MARKS)
    if not limited and how >= 0.8:  # inside a code of the page, or of a character
        code = rnd.choice(CODES)
        left = code[: rnd.randrange(1, len(code))] if rnd.random() < 0.9 else "�"
    return e[: rnd.randrange(min(5, len(e) - 1), len(e))] + left, limited, False


class TruncationModel:
    """Weights of known features, then of unknown ones by the length of the list (that is, the kind) and the place in it."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, least: dict[int, float] | None = None):
        self.known, self.weights, self.least = known, weights, least or {}

    @staticmethod
    def index(known: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = np.diff(at)
        place = np.arange(len(flat)) - np.repeat(at[:-1], size)
        return np.where(known[flat], flat, DIM + np.repeat(size, size) * 64 + place)

    def score(self, groups: list[Group]) -> float:
        """Above 0: more likely cut than whole. A group's sum is made once, as long as the cache holds it."""
        sums = self.__dict__.setdefault("_sums", {})
        size = sum(map(len, groups))
        z, place = -self.least.get(size, 0.0), 0
        for g in groups:
            if (part := sums.get((size, place, g))) is None:
                if len(sums) >= CACHED:
                    sums.clear()
                at = np.array(g)
                unknown = DIM + size * 64 + place + np.arange(len(g))
                part = sums[size, place, g] = float(self.weights[np.where(self.known[at], at, unknown)].astype(np.float64).sum())
            z += part
            place += len(g)
        return z

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_sums"}


def train(df: DataFrame, total: int, train_rows: int = TRAIN_ROWS) -> TruncationModel:
    """A model from about ``train_rows`` rows of ``df``(id, e, kind, at_e, at_t), chosen by a hash of their id."""
    part = min(1.0, train_rows / max(1, total))
    some = df.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000)) < int(part * 1_000_000) + 1).limit(int(train_rows * 1.5))
    got = some.select(F.xxhash64("id").alias("h"), "e", "kind", "at_e", "at_t").toPandas().sort_values(["h", "e"])
    shown, blind, y, at = [], [], [], []
    for h, e, k, at_e, at_t in got.itertuples(index=False):
        made = [(e, at_e, at_t, 0)]
        if len(e) > 8:
            made.append((*cut(e, k, random.Random(h)), 1))
        for text, a, b, label in made:
            shown.append(feature_list(text, k, bool(a), bool(b)))
            blind.append(feature_list(text, k, False, False))
            y.append(label)
            at.append(bool(a or b))
    y, at, size = np.array(y, dtype=float), np.array(at, dtype=bool), np.array([len(r) for r in shown])
    known = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *map(np.array, shown)]).astype(np.int64), minlength=DIM) >= KNOWN_FROM
    rows, first = [_indices(known, xs) for xs in (shown, blind)]
    weights, least = np.zeros(DIM + 64 * 64), {}
    for n in np.unique(size).tolist():  # kind by kind: features carry it, so only the bias would be shared
        own = np.flatnonzero(size == n)
        w, least[n] = _fit_kind([rows[i] for i in own], [first[i] for i in own], y[own], at[own])
        weights += w
    return TruncationModel(known, weights.astype(np.float32), least)


def _indices(known: np.ndarray, lists: list[list[int]]) -> list[np.ndarray]:
    if not lists:
        return []
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return np.split(TruncationModel.index(known, np.concatenate(lists), at), at[1:-1])


def _fit_kind(rows: list[np.ndarray], blind: list[np.ndarray], y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and the score from which a value is more likely cut than whole."""
    dim, made = DIM + 64 * 64, y == 1
    score = lambda w, xs: np.array([w[0] + w[r].sum() for r in xs])
    # Without knowing of limits, and at first without the values at limits, as many of those are cut.
    keep = made | ~at
    for _ in range(2):
        w = fit([r for r, k in zip(blind, keep) if k], y[keep], dim)
        keep = made | (score(w, blind) < np.where(at, -1.5, 0.0))
    w = fit([r for r, k in zip(rows, keep) if k], y[keep], dim)
    # The share of cut values, as the one that the scores of the sample's own values bear out.
    own, share = np.exp(np.clip(score(w, rows)[~made], -30, 30)), 0.1
    for _ in range(100 if len(own) else 0):
        share = min(0.9, max(0.005, float(np.mean(share * own / (share * own + 1 - share)))))
    bias, w[0] = w[0], 0.0
    return w, float(np.log((1 - share) / share)) - float(bias)


def truncated(rows: DataFrame, id_col: str, text_col: str, source_col: str, *, train_rows: int = TRAIN_ROWS, every: bool = False, with_source: bool = False) -> DataFrame:
    """(id, score) of every row found cut (score above 0: more likely cut than whole); with ``every`` of all rows with a value,
    with ``with_source`` also ``src``, the source or the empty text.

    Null and blank values are not cut; repeated rows each count; a null source is a source of its own;
    long values are read whole; an empty table gives no rows. Other columns are not read.
    """
    forms, _ = materialize(source_forms(rows, text_col, source_col), "forms")
    whole = shaped(rows, id_col, text_col, source_col, forms)
    lim, _ = materialize(limits(whole), "limits")
    df = with_limits(whole, lim).select("id", *(["src"] if with_source else []), "e", "kind", "at_e", "at_t")
    model = train(df, rows.count(), train_rows)
    keep_columns = ["id", "src"] if with_source else ["id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = zip(*(b.column(c).to_pylist() for c in ("e", "kind", "at_e", "at_t")))
            z = np.array([model.score(feature_groups(*x)) for x in values], dtype=np.float64)
            if every:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep_columns), pa.array(z)], [*keep_columns, "score"])
            else:
                keep = pa.array(z > 0)
                yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in keep_columns), pa.array(z).filter(keep)], [*keep_columns, "score"])

    kind = dict(rows.dtypes)[id_col]
    return df.mapInArrow(score, f"id {kind}, {'src string, ' if with_source else ''}score double").withColumnRenamed("id", id_col)
