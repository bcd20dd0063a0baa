"""Sentence units of texts in any language and script.

Blank lines divide a text into blocks. Within a block, candidates are runs of closing marks that white
space follows (marks of scripts without spaces need none), and, in Thai, spaces. Candidates inside a
quotation or parenthesis are none. A maximum-entropy classifier decides the rest from the token before
and after, its case, length, digits and script, and how often the token ends or starts blocks, counted
over all documents. Its weights are fitted on a bounded sample of them, without labels: ends of blocks are sure boundaries, candidates before a small letter are surely
none. Each cased example is also shown without its case, for texts all in small or capital letters.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.maxent import fit

DIM = 1 << 18
#: A token seen less often than this counts as unknown.
KNOWN_FROM = 3
#: So many counts are held in a task before they are handed on.
HELD_COUNTS = 200_000
#: The classifier's weights are fitted on about this many documents, chosen by a hash of their id; never more than 1.25 times as many.
TRAIN_DOCS = 6_000

#: A line break, then at least one more with only white space between; a paragraph mark alone. Atomic, so the two characters of one break are never taken for two.
_BLANK = re.compile(r"[\n\r\x85\u2028\u2029](?:(?<=\u2029)|(?:(?<=\r)\n)?+(?:[^\S\n\r\x85\u2028\u2029]*(?>\r\n|[\n\r\x85\u2028]))+)")
#: Marks that end sentences; those in NOSPACE also where no space follows.
_NOSPACE = "。！？｡"
_MARKS = ".!?…" + _NOSPACE + "．।॥۔؟։።፧។။།𑅁;\u037e"
_CLOSE = "\"')]}»”’›“‘」』）】》〉«"
_CAND = re.compile(rf"[{re.escape(_MARKS)}][{re.escape(_MARKS)}]*(?:\xa0?[{re.escape(_MARKS)}])*[{re.escape(_CLOSE)}]*")
_THAI = "ก-๛"
_ANY_THAI = re.compile(f"[{_THAI}]")
_GREEK = re.compile("[Ͱ-Ͽ]{2}")
_THAI_GAP = re.compile(rf"(?<=[{_THAI}])[ \t\n\r\u3000]+(?=\S)|(?<=[^\s{_THAI}])[ \t\n\r]+(?=[{_THAI}])")
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“”", "“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "‹": "›"}
_QUOTE = re.compile(r"[\"()\[\]{}«»„“”‘’「」『』（）【】《》〈〉‹›]")
_SPACE = re.compile(r"\s")
_FOREIGN = re.compile(r".*[฀-\u0eff\u3000-\u9fff\uac00-\ud7af\uff00-\uffef]")
_LISTMARK = re.compile(r"\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]")
LONGEST_LISTMARK = 6
#: List marks and bullets at the head of a unit: what follows them is the unit's first token.
_HEADMARK = re.compile(r"(?:\((?:\d{1,3}|[A-Za-z]|[ivx]{1,4})\)|(?:\d{1,3}|[a-z]|[ivx]{1,4})\)|\d{1,3}\.|[-•*·–>])")
_HEADS = frozenset("(0123456789abcdefghijklmnopqrstuvwxyz-•*·–>")
#: A token with one of these is an address, so a mark inside it ends nothing.
_ADDRESS = re.compile(r"[/@_]|www\.|[^\W\d_A-Z]{2}\.[^\W\d_A-Z]{2}")
_NEXT = re.compile(r"[^\s.,;:!?…。！？، ؛\"'”’»)」]+")


@lru_cache(maxsize=65_536)
def _script(ch: str) -> str:
    if ch < "ɐ":
        return "LATIN"
    return unicodedata.name(ch, "?").split(" ", 1)[0]


def _closed_spans(t: str) -> list[tuple[int, int]]:
    """Outermost matched quotations and parentheses of a block, as (opening, closing) places; in linear time at any depth."""
    stack: list[tuple[str, int]] = []
    depths: dict[str, list[int]] = {}  # where in the stack the openings of a kind are
    spans: list[tuple[int, int]] = []
    n = len(t)

    def open_(kind: str, at: int) -> None:
        depths.setdefault(kind, []).append(len(stack))
        stack.append((kind, at))

    def close(kinds: str, at: int) -> bool:
        k = max((depths[x][-1] for x in set(kinds) if depths.get(x)), default=-1)
        if k < 0:
            return False
        spans.append((stack[k][1], at))
        while len(stack) > k:
            depths[stack.pop()[0]].pop()
        return True

    skip = -1
    for m in _QUOTE.finditer(t):
        i, c = m.start(), m.group()
        if i <= skip:
            continue
        before, after = t[i - 1] if i else " ", t[i + 1] if i + 1 < n else " "
        if c == '"':
            if depths.get('"'):
                if not (before.isspace() and not after.isspace()):
                    close('"', i)
            elif not after.isspace() and not (before.isalnum() and before < "ɐ"):
                open_(c, i)
        elif c in "’‘" and after == c:  # doubled: ’’ … ‘‘ (or the other way round)
            skip = i + 1
            if not close("’’‘‘".replace(c, ""), i + 1):
                open_(c, i)
        elif c == "’":
            if not (before.isalnum() and after.isalnum()):
                close("‘", i)
        elif c == "“":
            if not close("„", i):
                open_(c, i)
        elif c == "”":
            close("“„”", i) or (after.isspace() or open_(c, i))
        elif c == "»":
            if not close("«", i) and not after.isspace():
                open_(c, i)
        elif c == "«":
            if not close("»", i):
                open_(c, i)
        elif c in _PAIRS:
            open_(c, i)
        else:
            close("".join(o for o, x in _PAIRS.items() if c in x), i)
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a > out[-1][1]:
            out.append((a, b))
        elif b > out[-1][1]:
            out[-1] = (out[-1][0], b)
    return out


@lru_cache(maxsize=1)
def _cases() -> np.ndarray:
    """By code point: 1 for a capital, 2 for a small letter, 0 for all else; the last place stands for all planes without case."""
    return np.array([1 if c.isupper() else 2 if c.islower() else 0 for c in map(chr, range(0x1F000))], dtype=np.uint8)


def _case_mode(text: str) -> str:
    """'n': letters' case tells; 'x': all small, all capital, or no case. Over the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    _, up, low = np.bincount(_cases()[np.minimum(codes, 0x1EFFF)], minlength=3).tolist()
    total = up + low
    if total < 20:
        return "n" if up else "x"
    return "x" if up == 0 or (total >= 60 and up / total < 0.004) or up / total > 0.6 else "n"


def _shape(tok: str) -> str:
    return re.sub(r"\d+", "9", tok.lower())


def _class(nxt: str) -> str:
    if not nxt:
        return "-"
    a = nxt[0]
    if a.isdigit():
        return "d"
    if a.isupper() or (len(nxt) > 1 and a.islower() and nxt[1].isupper()):
        return "U"
    if a.islower():
        return "l"
    if a.isalpha():
        return "c"
    return a


class _Left:
    """What stands before a candidate and its mark, as far as features need it. Equal ones are mostly one object."""

    __slots__ = ("ek", "script", "mark", "digit", "quote", "thai", "length", "kind")


class _Right:
    """The token after a candidate."""

    __slots__ = ("sk", "cls")


#: So many entries a cache of a task holds before it starts anew.
CACHED = 1 << 17
_OPENING = "\"'([{«„“"
_LEFT: dict[tuple, _Left] = {}
_RIGHT: dict[str, _Right | None] = {}


def _left(t: str, at: int, end: int, thai: bool) -> _Left:
    """Of the candidate whose mark begins ``at`` and whose closing marks end at ``end``."""
    head = t[max(0, at - 40) : at]
    if not head or head[-1].isspace():
        word = prev = ""
    else:
        parts = head.rsplit(None, 2)
        word, prev = parts[-1], parts[-2] if len(parts) > 1 else ""
    tail = t[at:end]
    digit = not prev.isalpha() and prev.lstrip(_OPENING)[-12:][:1].isdigit()
    key = (word, tail, digit, thai)
    if (c := _LEFT.get(key)) is not None:
        return c
    c = _Left()
    word = word.lstrip("\"'([{«„“‘¿¡（「『")
    if word and word[-1] < "ɐ" and (x := _FOREIGN.search(word)):
        word = word[x.end() :]
    c.script = _script(word[-1]) if word else "NONE"
    if thai:
        word = word[-4:]
    elif tail[:1] and tail[0] in _NOSPACE:
        word = ""
    shape = _shape(word)[-16:]
    c.mark, c.length, c.thai, c.digit = re.sub(r"(.)\1+", r"\1\1", tail), min(len(word), 8), thai, "d" if digit else ""
    c.ek = f"{shape}{tail}"
    c.kind = "s" if not shape else "i" if len(shape) == 1 else "n" if shape.strip("9.,$%") == "" else "a" if "." in shape else "w"
    c.quote = "q" if tail[-1:] in "\"'»”’›“‘」』«" else "p" if tail[-1:] in ")]}）】》〉" else ""
    if len(_LEFT) >= CACHED:
        _LEFT.clear()
    _LEFT[key] = c
    return c


def _right_of(token: str) -> _Right:
    w = _NEXT.match(token)
    nxt = w.group() if w else token[:1]
    opener = token[:1] if token[:1] in "\"'([{«„“‘¿¡（「『—–-" else ""
    if opener and len(token) > 1:
        w = _NEXT.match(token, 1)
        nxt = w.group() if w else nxt
    c = _Right()
    c.cls = _class(nxt)
    c.sk = opener + (_shape(nxt)[:2] if nxt and _script(nxt[0]) in ("CJK", "HIRAGANA", "KATAKANA", "THAI") else _shape(nxt)[:12])
    return c


def _right(follow: str) -> _Right:
    """Of the text after a candidate. What stands behind a list mark or bullet is the first token."""
    tokens = follow.split(None, 2)
    token = tokens[0] if tokens else ""
    if len(tokens) > 1 and len(token) < 7 and token[0] in _HEADS and _HEADMARK.fullmatch(token):
        token = tokens[1]
    c = _RIGHT.get(token)
    if c is None:
        if len(_RIGHT) >= CACHED:
            _RIGHT.clear()
        c = _RIGHT[token] = _right_of(token)
    return c


def _blocks(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _BLANK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    res = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            res.append((a, b))
    return res


def _candidates(t: str, thai_text: bool) -> list[tuple[int, int, bool]]:
    """(mark, end, whether a Thai gap) of the candidates of a block in order, without its end; ``thai_text``: whether to look for gaps."""
    n, found, token_end, address, greek = len(t), [], -1, False, None
    spans = _closed_spans(t) if _QUOTE.search(t) else []
    opens = [a for a, _ in spans]
    for m in _CAND.finditer(t):
        at, end = m.span()
        first = t[at]
        if not spans and first in ".!?" and end < n and t[end].isspace():
            found.append((at, end, False))
            continue
        if first in ";\u037e":
            if greek is None:
                greek = bool(_GREEK.search(t))
            if not greek:
                continue
        if spans and t[end - 1] in _CLOSE:  # an opening quotation may stand right behind
            k = bisect_right(opens, at)
            inner = opens[k] if k < len(opens) and opens[k] < end else end
            if first in _NOSPACE and inner == end and t[end - 1] in "“‘«":
                end = at + len(t[at:end].rstrip("“‘«"))
            else:
                end = inner
        elif first in _NOSPACE and t[end - 1] in "“‘«":
            end = at + len(t[at:end].rstrip("“‘«"))
        if end < n and not t[end].isspace() and first not in _NOSPACE and not (opens and opens[min(bisect_left(opens, end), len(opens) - 1)] == end):
            if not (first in ".!?" and at and t[end].isupper() and end + 1 < n and (t[end + 1].islower() or t[end + 1].isspace())):
                continue
            if end >= token_end:  # the token around the mark, each looked at once
                begin = end - len(t[max(0, token_end, 0) : end].rsplit(None, 1)[-1])
                gap = _SPACE.search(t, end)
                token_end = gap.start() if gap else n
                address = bool(_ADDRESS.search(t, begin, token_end))
            if address:
                continue
        found.append((at, end, False))
    if thai_text and _ANY_THAI.search(t):
        taken = {e for _, e, _ in found}
        found += [(m.start(), m.start(), True) for m in _THAI_GAP.finditer(t) if m.start() not in taken]
        found.sort()
    if not spans:
        return [c for c in found if c[1] < n]
    out, k = [], 0
    for c in found:
        at, end, thai = c
        if end >= n:
            continue
        while k < len(spans) and spans[k][1] < end - (not thai):
            k += 1
        if not (k < len(spans) and spans[k][0] < at and end <= spans[k][1]):
            out.append(c)
    return out


def _bin(part: int, whole: int) -> str:
    if whole < KNOWN_FROM:
        return "rare"
    size = "s" if whole < 8 else "m" if whole < 25 else "b"
    r = part / whole
    return size + ("0" if part == 0 else "a" if r < 0.02 else "b" if r < 0.06 else "c" if r < 0.15 else "d")


class SentenceModel:
    """Weights, and of each token seen ``KNOWN_FROM`` times or more (how often, how often at a block's end or start)."""

    def __init__(self) -> None:
        self.weights = np.zeros(DIM, dtype=np.float32)
        self.ends: dict[str, tuple[int, int]] = {}
        self.pairs: dict[str, tuple[int, int]] = {}
        self.starts: dict[str, tuple[int, int]] = {}

    def features(self, c: _Left, r: _Right, mode: str, is_end: int = -1) -> list[int]:
        """Indices of the active features. ``is_end`` 0 or 1: leave this example out of the counts."""
        own, end = (1, is_end) if is_end >= 0 else (0, 0)
        te, ee = self.ends.get(c.ek, (own, end))
        tp, ep = self.pairs.get(f"{c.ek}|{r.cls}", (own, end))
        ts, es = self.starts.get(r.sk, (own, end))
        eb, pb, sb = _bin(ee - end, te - own), _bin(ep - end, tp - own), _bin(es - end, ts - own)
        cls = r.cls if mode == "n" else ("x" if r.cls in "Ulc" else r.cls)
        mark = c.mark
        if c.thai:
            f = [f"T{eb}", f"Ts{sb}", f"Tw{c.ek}", f"Te{eb}{sb}", f"Tc{c.script}{cls}", f"Tl{c.script == 'THAI'}"]
        else:
            f = [
                f"e{eb}", f"p{pb}", f"s{sb}", f"es{eb}{sb}", f"ps{pb}{sb}", f"c{cls}", f"m{mark}", f"mc{mark}{cls}", f"ec{eb}{cls}", f"w{c.ek}", f"wn{c.ek}|{cls}",
                f"k{c.kind}{c.length}", f"kc{c.kind}{cls}", f"n{r.sk}", f"q{c.quote}{cls}", f"sc{c.script}{mark[:1]}", f"d{c.digit}{c.ek}",
            ]
        return [1 + zlib.crc32(x.encode()) % (DIM - 1) for x in f]

    def is_boundary(self, c: _Left, r: _Right, mode: str) -> bool:
        """Decided once for each pair of contexts, as long as the cache holds it."""
        known = self.__dict__.setdefault("_decided", {})
        if (hit := known.get((c, r, mode))) is None:
            if len(known) >= CACHED:
                known.clear()
            w = self.weights
            hit = known[c, r, mode] = float(w[0]) + sum(float(w[i]) for i in self.features(c, r, mode)) > 0
        return hit

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_decided"}

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """Places (start, end) of the sentences of a text; none for null and blank texts."""
        if not text or text.isspace():
            return []
        mode, thai, out = _case_mode(text), bool(_ANY_THAI.search(text)), []
        known = self.__dict__.setdefault("_decided", {})
        for a, b in _blocks(text):
            t, start = text[a:b], 0
            for at, end, gap in _candidates(t, thai):
                if end - start <= LONGEST_LISTMARK and _LISTMARK.fullmatch(t, start, end):
                    continue
                c, r = _left(t, at, end, gap), _right(t[end : end + 60])
                if (ends := known.get((c, r, mode))) is None:
                    ends = self.is_boundary(c, r, mode)
                if not ends:
                    continue
                out.append((a + start, a + end))
                start = end
                while start < len(t) and t[start].isspace():
                    start += 1
            if start < len(t):
                out.append((a + start, b))
        return out


def _block_end(t: str) -> tuple[int, int, bool] | None:
    """The end of a block as a candidate, if a closing mark or Thai letter stands there."""
    if "ก" <= t[-1] <= "๛":
        return len(t), len(t), True
    for m in _CAND.finditer(t, max(0, len(t) - 8)):
        if m.end() == len(t) and m.start():
            return None if m.group()[0] in ";\u037e" and not _GREEK.search(t) else (m.start(), m.end(), False)
    return None


def _examples(text: str | None) -> tuple[list[tuple[_Left, _Right, int]], list[_Right]]:
    """Candidates of a text (0) and ends of its blocks (1); the first tokens of blocks whose start no such end counts."""
    seen, heads, ended = [], [], False
    blocks = _blocks(text) if text else []
    thai = bool(_ANY_THAI.search(text)) if blocks else False
    for k, (a, b) in enumerate(blocks):
        t = text[a:b]
        if not ended:  # else the block before counts its start
            heads.append(_right(t[:60]))
        ended = False
        seen += [(_left(t, at, end, gap), _right(t[end : end + 60]), 0) for at, end, gap in _candidates(t, thai)]
        if k + 1 < len(blocks) and (c := _block_end(t)):
            at = blocks[k + 1][0]
            seen.append((_left(t, *c), _right(text[at : at + 60]), 1))
            ended = True
    return seen, heads


def _tally(contexts: Counter) -> Counter:
    """Of counted (left or None, right, whether at a block's end or start): counts by (table, token, whether at an edge)."""
    counts = Counter()
    for (c, r, end), n in contexts.items():
        if c is not None:
            counts["ends", c.ek, end] += n
            counts["pairs", f"{c.ek}|{r.cls}", end] += n
        counts["starts", r.sk, end] += n
    return counts


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(place, token, n, n_edge) of the tokens seen ``KNOWN_FROM`` times or more in all documents: a pass that shuffles counts only."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Counter()

        def rows() -> pa.RecordBatch:
            counts = _tally(contexts)
            contexts.clear()
            places, tokens, edges = zip(*counts)
            return pa.RecordBatch.from_arrays([pa.array(places), pa.array(tokens), pa.array(edges, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["place", "token", "edge", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen, heads = _examples(t)
                contexts.update(seen)
                contexts.update((None, r, 1) for r in heads)
                if len(contexts) >= HELD_COUNTS:
                    yield rows()
        if contexts:
            yield rows()

    some = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")).mapInArrow(tally, "place string, token string, edge bigint, n bigint")
    return some.groupBy("place", "token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("edge")).alias("n_edge")).where(F.col("n") >= KNOWN_FROM)


def train(texts: list[str], counts: Iterable[tuple[str, str, int, int]] | None = None) -> SentenceModel:
    """A model from unlabelled texts; without texts it cuts nowhere but at blank lines.

    ``counts``: rows of ``token_counts`` over documents that include ``texts``; without, those of ``texts``.
    """
    model, seen, contexts = SentenceModel(), Counter(), Counter()
    for text in texts:
        found, heads = _examples(text)
        contexts.update(found)
        contexts.update((None, r, 1) for r in heads)
        mode = _case_mode(text) if found else "x"
        seen.update((c, r, mode, end) for c, r, end in found)
    if counts is None:
        own = _tally(contexts)
        whole = {(p, k): own[p, k, 0] + own[p, k, 1] for p, k, _ in list(own)}
        counts = [(p, k, n, own[p, k, 1]) for (p, k), n in whole.items() if n >= KNOWN_FROM]
    for place, token, n, n_edge in counts:
        getattr(model, place)[token] = (n, n_edge)
    rows, y, times = [], [], []
    never = lambda table, key, least: (x := table.get(key, (0, 0)))[0] >= least and not x[1]
    for (c, r, mode, end), n in seen.items():
        if end:
            label = 1
        elif c.thai and c.script != "THAI" or not c.thai and r.cls == "l" and mode == "n":
            label = 0
        elif never(model.ends, c.ek, 25) or never(model.starts, r.sk, 15) or r.cls == "d" and c.script in ("LATIN", "CYRILLIC", "GREEK") and never(model.ends, c.ek, 3):
            label = 0  # often seen, but at no block's end or start
        else:
            continue
        for m in ("n", "x") if mode == "n" and not c.thai else (mode,):
            rows.append(np.array(model.features(c, r, m, end)))
            y.append(label)
            times.append(n)
    model.weights = fit(rows, np.array(y), DIM, times=np.array(times, dtype=float)).astype(np.float32) if rows else model.weights
    if not rows:
        model.weights[0] = -1
    return model


def fit_model(docs: DataFrame, id_col: str, text_col: str, train_docs: int = TRAIN_DOCS) -> SentenceModel:
    """The model with the counts of all documents and weights fitted on about ``train_docs`` of them."""
    share = min(1.0, train_docs / max(1, docs.count()))
    some = docs.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(id_col, F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    got = some.select(F.col(text_col).alias("t")).limit(train_docs + train_docs // 4).toPandas()
    counts = token_counts(docs, text_col).toPandas()
    return train(got["t"].tolist(), zip(*(counts[c].tolist() for c in ("place", "token", "n", "n_edge"))))


def sentences(docs: DataFrame, id_col: str, text_col: str, *, model: SentenceModel | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(id, sent_start, sent_end) of every sentence; places are code points from 0, the end exclusive.

    Null and blank texts give no rows; long texts are read whole; repeated documents each come out; a
    null id is passed through; an empty table gives no rows. Other columns are not read.
    """
    model = model or fit_model(docs, id_col, text_col, train_docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, counts = [], []
            for t in b.column(1).to_pylist():
                found = model.units(t)
                places += found
                counts.append(len(found))
            at = np.array(places, dtype=np.int64).reshape(-1, 2)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at[:, 0]), pa.array(at[:, 1])], ["i", "sent_start", "sent_end"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(cut, f"i {kind}, sent_start bigint, sent_end bigint").withColumnRenamed("i", id_col)


def violations(texts: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    """(check, violations) of ``texts`` with their sentences (an array of start and end, in order; null for none): all 0 if they are sound.

    Sentences must not overlap nor begin or end with white space, and what lies between them must be blank.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = Counter(dict.fromkeys(("overlap", "blank_edge", "left_out", "no_sentence"), 0))
        for b in batches:
            for t, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                for s in spans or []:
                    start, end = s["sent_start"], s["sent_end"]
                    bad["overlap"] += start < at or end <= start
                    bad["blank_edge"] += t[start:end] != t[start:end].strip()
                    bad["left_out"] += bool(t[at:start].strip())
                    at = end
                bad["left_out" if spans else "no_sentence"] += bool(t[at:].strip())
        yield pa.RecordBatch.from_arrays([pa.array(list(bad)), pa.array(list(bad.values()), pa.int64())], ["check", "violations"])

    got = texts.select(text_col, spans_col).mapInArrow(look, "check string, violations bigint")
    return got.groupBy("check").agg(F.sum("violations").alias("violations"))
