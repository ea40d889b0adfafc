"""Column factories over text: all of them plain SQL expressions.

Patterns carry ``(?U)`` wherever word boundaries matter, so that a letter of
any script ends a word just like an ASCII one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: patterns and word lists results depend on. ----
WORDS = r"[A-Za-z0-9]+|[가-힣]+"
MODEL = r"(?U)\b([A-Z]{2}\d{2,4}[a-z]?)\s+(V\d+)\b"
BRAND = "ThinkSystem"
IDENTIFIER = (
    r"(?iU)\b(?:[A-Za-z]{1,6}[0-9][A-Za-z0-9./\-]*"
    r"|[0-9]{1,4}(?:\.[0-9]+)?\s?(?:TB|GB|MB|PB|KB|W|V|A|U|mm|cm|kg|lb|MHz|GHz|MT/s|Gb/s|Gbps|inch|nm)"
    r"|[0-9][A-Za-z][A-Za-z0-9]{2,})\b"
)
MEASURE = r"(?iU)\b\d+(?:[.,]\d+)?\s?(?:TB|GB|MB|PB|KB|Gbps|Gb/s|MT/s|MHz|GHz|W|V|A|U|mm|cm|kg|lb|inch|nm|rpm|BTU)\b"
CODE = r"(?U)\b(?=[A-Za-z0-9./\-]*\d)(?=[A-Za-z0-9./\-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9./\-]{2,}\b"
CITATION = r"\[(\d+)\]"
UNIT_NOTE = r"\(\s*(?:단위|단위당|Unit|UNIT|unit)\s*[:：]?\s*[^)]{1,24}\)"
PARTICLES = (
    "으로서", "으로써", "에서의", "에게서", "이라는", "이었나요", "인가요", "일까요", "입니까", "이에요", "라는", "이란", "으로", "에서", "에게", "까지", "부터", "보다", "처럼", "마다",
    "이나", "든지", "이며", "이고", "인가", "인지", "예요", "이다", "은", "는", "이", "가", "을", "를", "의", "와", "과", "도", "만", "로", "에", "야", "랑",
)
SPEC_HINTS = ("용량", "최대", "최소", "몇", "얼마", "크기", "무게", "속도", "전력", "개수", "수량", "사양", "스펙", "지원", "온도", "높이", "효율")
PROCEDURE_HINTS = ("방법", "절차", "설치", "설정", "구성하", "어떻게", "순서", "how to", "install", "configure")
COMPARE_HINTS = ("비교", "차이", "대비", "vs", "versus", "어느 쪽", "중 어떤")
QUESTION_ENDS = ("는?", "은?", "까?")
NOT_FOUND = "제공된 문서에서 찾지 못했습니다."
SLIDE, ADJACENT = "슬라이드 ", "\n(인접 행) "
# ---- End of fixed values. ----


def normalise_cell(cell: Column) -> Column:
    """White space runs become one space, ends are cut; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, or of Hangul."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def products_in(text: Column) -> Column:
    """Product names in order of first appearance, each once."""
    found = F.regexp_extract_all(text, F.lit(MODEL), F.lit(0))
    named = F.transform(found, lambda m: F.concat(F.lit(BRAND + " "), F.regexp_replace(m, r"(?U)\s+", " ")))
    return F.array_distinct(named)


def narrow_products(text: Column, candidates: Column) -> Column:
    """The one candidate whose model code occurs in the text; all of them if
    none or several do.  A code within a longer one counts."""
    hits = F.filter(candidates, lambda c: F.contains(text, F.get(F.split(c, " "), F.lit(1))))
    return F.when(F.size(hits) == 1, hits).otherwise(candidates)


def boilerplate_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\d+", "#"))


def token_estimate(text: Column) -> Column:
    """max(1, half-even rounding of ASCII characters / 4 + others / 1.5)."""
    others = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.bround((F.length(text) - others) / F.lit(4.0) + others / F.lit(1.5)).cast("int"))


def content_hash(products: Column, body: Column) -> Column:
    """Equal for equal products in any order and bodies equal but for white
    space and case."""
    return F.md5(F.concat(F.array_join(F.array_sort(products), "|"), F.lit("||"), F.lower(F.trim(F.regexp_replace(body, r"(?U)\s+", " ")))))


def context_header(products: Column, section: Column) -> Column:
    """``label > section``; whatever is empty is left out."""
    return F.concat_ws(" > ", F.nullif(F.array_join(products, " / "), F.lit("")), F.nullif(F.coalesce(section, F.lit("")), F.lit("")))


def with_header(products: Column, section: Column, title: Column, body: Column) -> Column:
    head = context_header(products, section)
    headed = F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body)
    return F.when(F.size(products) > 0, headed).otherwise(F.concat(title, F.lit("\n"), headed))


def strip_particles(token: Column) -> Column:
    """Without the longest particle at the end that leaves a character."""
    ends = "|".join(sorted(PARTICLES, key=lambda p: (-len(p), p)))
    return F.regexp_replace(token, f"(?<=.)(?:{ends})$", "")


def identifiers(text: Column) -> Column:
    """Codes and measures; those with white space also without it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda x: F.trim(x))
    both = F.flatten(F.transform(found, lambda x: F.array(x, F.regexp_replace(x, r"(?U)\s+", ""))))
    return F.array_distinct(both)


def _any(text: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(text, F.lit(h))
    return out


def intent(question: Column, products: Column) -> Column:
    low = F.lower(question)
    ends = F.lit(False)
    for e in QUESTION_ENDS:
        ends = ends | F.rtrim(question).endswith(e)
    return (
        F.when((F.size(products) > 1) | _any(low, COMPARE_HINTS), "comparison")
        .when(_any(low, PROCEDURE_HINTS), "procedure")
        .when(_any(question, SPEC_HINTS) | ends, "spec")
        .otherwise("general")
    )


def squeeze(text: Column) -> Column:
    """Without white space and commas, lower-cased: for comparing values."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s,]+", ""))


def claims(answer: Column) -> Column:
    """Measures, then codes, of an answer without its citations; each once."""
    body = F.regexp_replace(answer, CITATION, " ")
    found = F.concat(F.regexp_extract_all(body, F.lit(MEASURE), F.lit(0)), F.regexp_extract_all(body, F.lit(CODE), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: squeeze(x) != ""))


def unsupported(answer: Column, evidence: Column) -> Column:
    """Claims that do not occur in the evidence (array of texts)."""
    hay = squeeze(F.array_join(evidence, "\n"))
    return F.filter(claims(answer), lambda c: (hay == "") | ~F.contains(hay, squeeze(c)))


def cited(answer: Column, limit: Column) -> Column:
    """Cited numbers, rising; null if there are none or any is out of range."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("long")))
    return F.when((F.size(found) > 0) & F.forall(found, lambda n: F.coalesce(n.between(1, limit), F.lit(False))), F.array_sort(found))


def is_not_found(answer: Column) -> Column:
    return F.contains(answer, F.lit(NOT_FOUND.rstrip(".")))


def expectation_met(answer: Column, expect: Column) -> Column:
    """Case-insensitive substring; null without an expectation."""
    return F.when(F.coalesce(expect, F.lit("")) != "", F.contains(F.lower(answer), F.lower(expect)))


def citation(title: Column, path: Column, page_from: Column, page_to: Column, section: Column) -> Column:
    """Where a chunk stands, in words."""
    pages = F.when(page_from == page_to, page_from.cast("string")).otherwise(F.concat_ws("-", page_from, page_to))
    mark = F.when(F.lower(path).endswith(".pptx"), F.lit(SLIDE)).otherwise(F.lit("p"))
    return F.when(F.coalesce(page_from, F.lit(0)) == 0, F.concat(title, F.lit(" · "), F.coalesce(section, F.lit("")))).otherwise(F.concat(title, F.lit(" "), mark, pages))


def context_block(content: Column, neighbours: Column) -> Column:
    return F.when(F.size(neighbours) > 0, F.concat(content, F.lit(ADJACENT), F.array_join(neighbours, " / "))).otherwise(content)


def excerpt(content: Column) -> Column:
    return F.substring(content, 1, 400)


def key_text(content: Column) -> Column:
    """The parts before ``:`` (of 80 characters at most) of each line."""
    heads = F.transform(F.filter(F.split(content, r"\R"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.substring_index(x, ":", 1))
    return F.lower(F.array_join(F.filter(heads, lambda h: F.length(h) <= 80), " "))


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(x, digits)
