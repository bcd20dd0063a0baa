"""Text functions: Column -> Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Latin letters with marks and what they fold to in search.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words a question's search leaves out.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "doing", "has", "have", "had", "having", "of", "in", "on", "to", "for",
    "with", "as", "at", "by", "from", "into", "and", "or", "but", "if", "then", "than", "so", "that", "this", "these", "those", "how", "what", "who", "whom", "why", "when",
    "where", "which", "whose", "i", "me", "my", "mine", "we", "us", "our", "you", "your", "yours", "they", "them", "their", "it", "its", "he", "she", "his", "her", "about",
    "can", "could", "would", "should", "will", "shall", "may", "might", "must", "get", "got", "getting", "any", "all", "some", "more", "most", "many", "much", "tell",
    "show", "give", "list", "please", "know", "want", "need", "there", "record", "records", "library", "verified", "vetted", "issue", "issues", "problem", "problems",
    "carrier", "carriers", "company", "companies", "over", "time", "yet", "still", "just", "only", "even", "ever",
]


def trim_all(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\s+", " "))


def _stands_in(low: Column, term: str) -> Column:
    """``term`` as a whole word in a small-letter text; the pattern only runs where the letters are there at all."""
    special = r".^$*+?()[{\|"
    escaped = "".join("\\" + ch if ch in special else ch for ch in term.lower())
    return F.contains(low, F.lit(term.lower())) & low.rlike(f"(?:^|[^a-z0-9]){escaped}(?:[^a-z0-9]|$)")


def contains_term(text: Column, term: str) -> Column:
    """Whether ``term`` stands in ``text`` as a whole word or phrase, in any letter case."""
    return _stands_in(F.lower(text), term)


def any_term(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | contains_term(text, t)
    return out


def first_match(text: Column, lists: list[tuple[str, list[str]]]) -> Column:
    """The first name, in the order given, one of whose terms stands in ``text``; else null."""
    out = F.lit(None).cast("string")
    for name, terms in reversed(lists):
        out = F.when(any_term(text, terms), F.lit(name)).otherwise(out)
    return out


def all_matches(text: Column, lists: list[tuple[str, list[str]]]) -> Column:
    """Every such name in order."""
    return F.array_compact(F.array(*(F.when(any_term(text, terms), F.lit(name)) for name, terms in lists)))


def decode_entities(c: Column) -> Column:
    """CDATA unwrapped, then the five named entities, the ampersand last."""
    out = F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(decode_entities(c), r"<[^>]+>", " "))


def page_lines(html: Column) -> Column:
    """A page's text lines for comparison: no scripts, styles, comments, tags, cache markers, blank or repeated lines."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]+>", "\n")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"(?i)[?&](cb|t|_|v|nocache)=[^\s\"']+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), squeeze), lambda x: F.length(x) > 0)
    return F.array_join(F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1))), "\n")


def sentences_lossless(c: Column) -> Column:
    """Pieces ending in a run of .!? before white space or the end, white space kept: joined they are the text again."""
    return F.regexp_extract_all(c, F.lit(r"(?s).*?[.!?]+(?:\s+|\z)|.+\z"), F.lit(0))


def numbers_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d[\d,\.]*\d|\d"), F.lit(0))


def foreign_numbers(c: Column, source: Column) -> Column:
    """Numbers of ``c`` that do not stand verbatim in ``source``."""
    return F.filter(numbers_in(c), lambda n: ~F.contains(source, n))


def _cells_named(cells: Column, key: str) -> Column:
    return F.filter(cells, lambda s: F.lower(trim_all(F.substring_index(s, "=", 1))) == key)


def excerpt_field(excerpt: Column, keys: list[str]) -> Column:
    """The raw value of the first of ``keys`` in ``head | key=value; key=value``; the first of equal keys wins; null if absent."""
    at = F.instr(excerpt, " | ")
    body = F.when(at > 0, F.substring(excerpt, at + 3, F.length(excerpt))).otherwise(excerpt)
    cells = F.filter(F.split(body, "; "), lambda s: F.contains(s, F.lit("=")))
    out = None
    for key in keys:
        hit = F.get(_cells_named(cells, key.lower()), F.lit(0))
        value = F.substring(hit, F.instr(hit, "=") + 1, F.length(hit))
        out = value if out is None else F.coalesce(out, value)
    return out


def feed_excerpt(title: Column, description: Column, most: int = 400) -> Column:
    """``title - description``, the description cut at ``most`` characters with an ellipsis; the title alone without one."""
    d = F.when(F.length(description) > most, F.concat(F.rtrim(F.substring(description, 1, most)), F.lit("..."))).otherwise(description)
    return F.when(F.coalesce(d, F.lit("")) != "", F.concat(title, F.lit(" - "), d)).otherwise(title)


def capped(c: Column, most: int = 900) -> Column:
    t = trim_all(c)
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(t)


def headline_source(title: Column, link: Column) -> Column:
    """What follows the title's last `` - `` if that is within the last 60 characters, else the link's host."""
    tail = F.substring_index(title, " - ", -1)
    cut = F.length(title) - F.length(tail) - 3
    return F.when(F.contains(title, F.lit(" - ")) & (cut > 0) & (F.length(title) - cut < 60), trim_all(tail)).otherwise(F.coalesce(F.regexp_extract(link, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


def post_permalink(uri: Column, base: str = "https://bsky.app/profile/") -> Column:
    """The web address of an ``at://`` post, or null for any other text."""
    rx = r"^at://([^/]+)/app\.bsky\.feed\.post/([^/]+)$"
    return F.when(uri.rlike(rx), F.concat(F.lit(base), F.regexp_extract(uri, rx, 1), F.lit("/post/"), F.regexp_extract(uri, rx, 2)))


def search_tokens(c: Column) -> Column:
    """Words for the index: letters and digits in lower case, marks folded."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def question_tokens(c: Column) -> Column:
    """Distinct words of a question that its search uses, in order."""
    raw = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS)))


def question_intent(c: Column) -> Column:
    """count, trend or topic."""
    h = F.lower(c)
    return F.when(h.rlike(r"\b(how many|number of|how much|count)\b"), "count").when(h.rlike(r"\b(improved?|improving|better|worse|worsened|trend|over time|changed over|gotten worse|getting better)\b"), "trend").otherwise("topic")


def source_category(source_id: Column) -> Column:
    s = F.lower(F.coalesce(source_id, F.lit("")))
    return F.when(F.contains(s, F.lit("arb")), "arbitration").when(F.contains(s, F.lit("court")), "court").otherwise("regulator_press")


def json_span(c: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing`` of a text that wraps JSON in prose, else null."""
    t = F.regexp_extract(c, rf"(?s)\{opening}.*\{closing}", 0)
    return F.when(t != "", t)
