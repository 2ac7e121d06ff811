"""Columns that clean and judge text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte limits of stored fields (fixed values).
LIMITS = {"body": 32768, "title": 512, "description": 2048, "keywords": 512}
#: Phrases by which a wall shows itself (fixed values).
WALL_PHRASES = [
    "javascript is disabled", "enable javascript", "not a robot", "checking your browser", "attention required", "unusual traffic", "captcha",
    "please wait for verification", "access denied", "access to this page has been denied",
    "로그인 또는 가입", "로그인이 필요", "자바스크립트를 활성화", "자바스크립트를 사용",
]
#: Marks of a page footer (fixed values).
FOOTER_MARKS = ["이용약관", "개인정보처리방침", "사업자등록번호", "통신판매업", "고객센터", "청소년보호정책", "저작권", "제휴문의", "대표이사", "all rights reserved"]
#: Named entities, from the standard library's table; characters that the references 128 to 159 stand for, by the code page they come from.
ENTITIES = json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})
_C1, _CP1252 = zip(*[(chr(n), bytes([n]).decode("cp1252")) for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)])


def cap_bytes(c: Column, n: int) -> Column:
    """At most n bytes, cut before the code point that would go over."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, n)
    code_points = F.decode(F.unhex(F.regexp_extract(F.hex(cut), r"^((?:[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)*)", 1)), "UTF-8")
    return F.when(F.octet_length(c) <= n, c).otherwise(code_points)


def sanitize(c: Column, keep_newline: bool = False) -> Column:
    """No invalid bytes, U+FFFD or control characters; tabs and returns are spaces; newlines stay or are spaces."""
    clean = F.translate(F.make_valid_utf8(c), "\t\r�", "  ")
    if not keep_newline:
        return F.regexp_replace(F.translate(clean, "\n", " "), r"\p{Cc}", "")
    return F.regexp_replace(clean, r"[\p{Cc}&&[^\n]]", "")


def clean(c: Column, limit: int, keep_newline: bool = False) -> Column:
    space = F.lit(" \n\t\r")
    return F.trim(cap_bytes(F.trim(sanitize(cap_bytes(c, limit), keep_newline), space), limit), space)


def _decoded(e: Column) -> Column:
    """The characters of one entity, &name; or &#number;. Unknown names and numbers that are no character stay."""
    digits = F.regexp_extract(e, r"^&#[xX]?0*([0-9A-Fa-f]*);$", 1)
    digits = F.when(digits == "", "0").otherwise(digits)
    long = F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    number = F.when((F.length(digits) <= 7) & long.rlike("^[0-9]+$"), long).otherwise(F.lit("1114112")).cast("int")
    # a code point's UTF-16 bytes: one unit, or two beyond U+FFFF
    high = F.lpad(F.hex(F.lit(0xD800) + F.floor((number - 0x10000) / 0x400)), 4, "0")
    low = F.lpad(F.hex(F.lit(0xDC00) + (number - 0x10000) % 0x400), 4, "0")
    units = F.when(number > 0xFFFF, F.concat(high, low)).otherwise(F.lpad(F.hex(number), 4, "0"))
    char = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.decode(F.unhex(units), "UTF-16BE")).otherwise(e)
    names = F.from_json(F.lit(ENTITIES), "map<string,string>")  # folded into one literal
    named = F.coalesce(F.try_element_at(names, F.regexp_extract(e, "^&(.*);$", 1)), e)
    char = F.when(number.between(0x80, 0x9F), F.translate(char, "".join(_C1), "".join(_CP1252))).otherwise(char)
    return F.when(e.startswith("&#"), char).otherwise(named)


def unescape_entities(c: Column) -> Column:
    """Named and numeric entities; those that stand for & come last, so that nothing is decoded twice."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)"), 1))
    pairs = F.transform(found, lambda e: F.struct(e.alias("e"), _decoded(e).alias("d")))
    in_order = F.concat(F.filter(pairs, lambda p: p["d"] != "&"), F.filter(pairs, lambda p: p["d"] == "&"))
    return F.when(c.contains("&"), F.aggregate(in_order, c, lambda text, p: F.replace(text, p["e"], p["d"]))).otherwise(c)


def clean_meta(c: Column, limit: int) -> Column:
    return clean(unescape_entities(c), limit)


def truncate_runes(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def is_thin(title: Column, description: Column, body: Column, least: int = 200) -> Column:
    return F.length(title) + F.length(description) + F.length(body) < least


def _marks(text: Column, marks: list[str]) -> Column:
    low = F.lower(text)
    return sum((low.contains(m).cast("int") for m in marks), F.lit(0))


def is_blocked_page(title: Column, description: Column, body: Column) -> Column:
    joined = F.concat_ws(" ", title, description, body)
    return (F.length(joined) < 400) & (_marks(joined, WALL_PHRASES) > 0)


def is_footer_only(body: Column) -> Column:
    return (F.length(body) > 0) & (F.length(body) < 1000) & (_marks(body, FOOTER_MARKS) >= 3)


def escape_formula(c: Column) -> Column:
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def fill_empty(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(old, F.lit("")), new)
