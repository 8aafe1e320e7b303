"""Text, number, time and JSON functions as column expressions."""

from __future__ import annotations

import json
import math
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width characters and their plain forms, codes and words of the domain.
WIDE = "".join(chr(0xFF01 + k) for k in range(94)) + "　"
PLAIN = "".join(chr(0x21 + k) for k in range(94)) + " "
GRADES = ("SS", "S1", "S2", "S3", "A1", "A2", "A3", "A4", "L1", "B1", "B2")
BET_TYPES = {"2枠複": "FRAME_QUINELLA", "2枠単": "FRAME_EXACTA", "2車複": "QUINELLA", "2車単": "EXACTA", "3連複": "TRIO", "3連単": "TRIFECTA", "ワイド": "QUINELLA_PLACE"}
ENTRY_STATES = {"失格": "DISQUALIFIED", "落車": "CRASHED", "欠場": "DID_NOT_START", "取消": "WITHDRAWN", "棄権": "DID_NOT_FINISH", "未完走": "DID_NOT_FINISH"}


def narrow(c: Column) -> Column:
    """Full-width letters, digits, marks and space as plain ones."""
    return F.translate(c, WIDE, PLAIN)


#: Characters by name, of all references that end in a semicolon.
NAMED = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})
#: A text's pieces: references in form, lone marks, and what lies between.
PIECE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|&|[^&]+"


def _reference(x: Column) -> Column:
    """What a piece of text stands for; a reference that means no character stays as it is."""
    inner = lambda skip: F.substr(x, F.lit(skip + 1), F.length(x) - F.lit(skip + 1))
    digits = F.when(x.rlike("^&#[xX]0*[0-9A-Fa-f]{1,6};$"), F.conv(F.regexp_replace(inner(3), "^0+(?=.)", ""), 16, 10)).when(x.rlike("^&#0*[0-9]{1,7};$"), inner(2))
    code = digits.cast("long")
    plain = code.between(0x20, 0x7E) | code.isin(0x09, 0x0A, 0x0C)
    known = code.between(0xA0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & ~code.between(0xFDD0, 0xFDEF) & (F.pmod(code, F.lit(0x10000)) < 0xFFFE)
    # A lone FEFF would be taken for a mark of byte order.
    char = F.when(code == 0xFEFF, "\ufeff").when(plain | known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    name = F.from_json(F.lit(NAMED), "map<string,string>")[inner(1)]
    return F.coalesce(F.when(x.startswith("&#"), char).when(F.length(x) > 2, F.when(x.startswith("&"), name)), x)


def decode_entities(c: Column) -> Column:
    """Character references decoded once, from left to right: every name that ends in a semicolon, and numbers of characters that
    a page may hold."""
    pieces = F.transform(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)), _reference)
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def normalise(c: Column) -> Column:
    """Entities decoded, white space one space, trimmed; an empty text or a lone dash is NULL."""
    c = decode_entities(c)
    c = F.btrim(F.regexp_replace(F.translate(c, "\u00a0\r\n\t", "    "), " +", " "), F.lit(" \x0b\x00"))
    return F.when(~c.isin("", "-", "－"), c)


def digits(c: Column) -> Column:
    """The digits of a text, full-width ones too; NULL if there are none."""
    found = F.regexp_replace(narrow(normalise(c)), "[^0-9]+", "")
    return F.when(found != "", found)


def grade(c: Column) -> Column:
    """The rider's grade without class and group words, or the raw text if it is no known grade."""
    plain = F.regexp_replace(F.regexp_replace(narrow(normalise(c)), "[級班]", ""), r"\s+", "")
    return F.when(plain.isin(*GRADES), plain).otherwise(F.when(normalise(c).isNotNull(), c))


def name_key(c: Column) -> Column:
    """A name without any space, for comparison."""
    return F.regexp_replace(normalise(c), "[\\s　]+", "")


def display_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s　]+", " "))


def category(c: Column) -> Column:
    """MEN, GIRLS or UNKNOWN by the race type."""
    t = narrow(c)
    return F.coalesce(F.when(t.contains("ガールズ") | t.contains("L級"), "GIRLS"), F.when(t.contains("S級") | t.contains("A級"), "MEN"), F.lit("UNKNOWN"))


def entry_state(c: Column) -> Column:
    """Result state named in a text, NULL if none is."""
    return F.coalesce(*(F.when(c.contains(word), state) for word, state in ENTRY_STATES.items()))


def bet_type(c: Column) -> Column:
    plain = F.replace(narrow(c), F.lit(" "), F.lit(""))
    return F.coalesce(*(F.when(plain == word, code) for word, code in BET_TYPES.items()))


def combination(c: Column) -> Column:
    """A bet's numbers in plain characters without spaces."""
    return F.regexp_replace(narrow(c), r"\s+", "")


def fixed2(c: Column) -> Column:
    """Two decimals as text, half up."""
    return F.round(c, 2).cast("decimal(18,2)").cast("string")


def positive_number(c: Column) -> Column:
    """A text as a positive finite double, else NULL."""
    x = c.try_cast("double")
    return F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)


def whole_number(c: Column) -> Column:
    """A text of digits as a number, else NULL."""
    return F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))


def minute_of_day(seconds: Column, hours_ahead: int = 9) -> Column:
    return (F.pmod(seconds + hours_ahead * 3600, F.lit(86400)) / 60).cast("int")


def on_circle(minute: Column) -> tuple[Column, Column]:
    """Sine and cosine of a minute of the day."""
    angle = minute * (2 * math.pi / 1440)
    return F.sin(angle), F.cos(angle)


def race_code(track: Column, day: Column, number: Column) -> Column:
    """track:yyyymmdd:NN."""
    return F.concat_ws(":", track.cast("string"), F.date_format(day, "yyyyMMdd"), F.lpad(number.cast("string"), 2, "0"))


def local_moment(day: Column, clock: Column, hours_ahead: int = 9) -> Column:
    """Seconds of a local date and HH:MM; NULL for a clock that is none."""
    parts = F.split(clock, ":")
    good = clock.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$")
    since = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return F.when(good, since + parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 - hours_ahead * 3600)
