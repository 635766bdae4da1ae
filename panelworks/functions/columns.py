"""Column functions: cleaning, parsing, codes, keys and labels. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(col: Column, book: dict, keep_unknown: bool = False) -> Column:
    """A code book lookup; unknown codes become null or stay as they are."""
    pairs = [F.lit(x) for kv in book.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return F.coalesce(found, col) if keep_unknown else found


def sentinel_null(col: Column, *bad, positive: bool = False) -> Column:
    """Null where the value is one of ``bad`` or, with ``positive``, not above zero."""
    wrong = col.isin(*bad) if bad else F.lit(False)
    if positive:
        wrong = wrong | (col <= 0)
    return F.when(~wrong, col)


def sentinel_reason(col: Column, reasons: dict[int, str]) -> tuple[Column, Column]:
    """(value or null, 'ok' / the code's reason / 'missing')."""
    reason = F.when(col.isNull(), "missing")
    for code, name in reasons.items():
        reason = reason.when(col == code, name)
    return F.when(~col.isin(*reasons), col), reason.otherwise("ok")


def suppressed(col: Column, tokens: tuple[str, ...] = ("*", "**", "n/a", ".", "..")) -> tuple[Column, Column]:
    """(number or null, whether the cell is a suppression token)."""
    text = F.lower(F.trim(col.cast("string")))
    flag = F.coalesce(text.isin(*tokens), F.lit(False))
    return F.when(~flag, text.try_cast("double")), flag


def parse_number(col: Column) -> Column:
    """Decimal comma, no-break and plain spaces, a leading ~; anything else is null."""
    return F.regexp_replace(F.regexp_replace(col, "[ \\s~]", ""), ",", ".").try_cast("double")


def in_range(col: Column, lo, hi) -> Column:
    return F.when(col.between(lo, hi), col)


def scaled(col: Column, factor: float, digits: int = 2) -> Column:
    """Unit conversion, rounded half to even."""
    return F.bround(col * F.lit(factor), digits)


def first_usable(choices: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(first non-null column, its tag)."""
    tag = reduce(lambda w, c: w.when(c[1].isNotNull(), c[0]), choices[1:], F.when(choices[0][1].isNotNull(), choices[0][0]))
    return F.coalesce(*[c for _, c in choices]), tag


def spring_year(date: Column, first_month: int = 7) -> Column:
    return F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)


def fixed_key(parts: list[tuple[Column, int]]) -> Column:
    """Zero-padded parts side by side; a null, blank or zero part makes the key null."""
    usable = [F.when((F.trim(c.cast("string")) != "") & (F.trim(c.cast("string")) != "0"), F.lpad(F.trim(c.cast("string")), w, "0")) for c, w in parts]
    return F.concat(*usable)


def has_words(text: Column, pattern: str) -> Column:
    """Whether a case-insensitive pattern is in the text, white space collapsed; null text has none."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ").rlike(f"(?i){pattern}")


def norm_place(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper case, without a closing '(County)'; aliases decoded."""
    plain = F.upper(F.trim(F.regexp_replace(name, r"(?i)\s*\(county\)\s*$", "")))
    return decode(plain, aliases, keep_unknown=True) if aliases else plain


#: How terms for special schools begin, word by word, before and after a reform of terms; and words that announce grades.
SPECIAL_TERMS = (("grundsärskol",), ("gymnasiesärskol",), ("anpassad", "grundskol"), ("anpassad", "gymnasieskol"), ("särskol",))
GRADE_WORDS = ("f", "ak", "åk", "arskurs", "årskurs")


def norm_entity(name: Column, vocabulary: tuple[tuple[str, ...], ...] = SPECIAL_TERMS) -> Column:
    """Lower case, without grade ranges, numbered units, the vocabulary, digits, punctuation and words of one to three of h, l, m.

    So names that differ in these only are equal; a unit that is named rather than numbered stays. A name is cut into words once, and words go
    by their class and by the word next to them."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\s*[-–]\s*", "-"), r"(?U)[^\w\s-]", " ")), r"\s+")
    span, number = r"^\d+-\d+$", r"^\d+$"

    def dropped(all_words: Column, w: Column, i: Column) -> Column:
        near = lambda k: F.coalesce(F.get(all_words, i + k), F.lit(""))
        grades = w.rlike(span) | F.regexp_replace(w, f"^({'|'.join(GRADE_WORDS)})", "").rlike(span) | w.isin(*GRADE_WORDS) & near(1).rlike(span)
        gone = grades | (w == "enhet") & near(1).rlike(number)
        for term in vocabulary:
            for k in range(len(term)):
                at = [near(j - k).startswith(x) if j == len(term) - 1 else near(j - k) == x for j, x in enumerate(term)]
                gone = gone | reduce(lambda x, y: x & y, at)
        return gone

    # the words are bound to a variable: as an expression they would be cut again at every look at a neighbour
    kept = F.transform(F.array(words), lambda ws: F.filter(ws, lambda w, i: ~dropped(ws, w, i)))
    left = F.split(F.regexp_replace(F.array_join(F.get(kept, F.lit(0)), " "), r"[\d-]+", " "), r"\s+")
    return F.array_join(F.filter(left, lambda w: (w != "") & ~w.rlike("^[hlm]{1,3}$")), " ")


def numbered_twins(a: Column, b: Column) -> Column:
    """Whether two different names are the same but for a closing number: siblings, not one unit renamed."""
    stem = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s*\d+\s*$", ""))
    return (a != b) & (stem(a) == stem(b))


def range_set(code: Column, names: dict[str, int] | None = None) -> Column:
    """'PK, 3-5' to [-1, 3, 4, 5]: comma-separated numbers, names and ranges; unreadable parts are left out."""
    names = names or {"PK": -1, "KG": 0}

    def number(x: Column) -> Column:
        x = F.upper(F.trim(x))
        return F.coalesce(decode(x, names), x.try_cast("int"))

    def part(x: Column) -> Column:
        ends = F.split(F.trim(x), r"(?<=\w)\s*-\s*")
        lo, hi = number(F.get(ends, F.lit(0))), number(F.element_at(ends, -1))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(code, F.lit("")), ","), lambda x: F.coalesce(part(x), F.array().cast("array<int>"))))))


def event_time(year: Column, first: Column) -> Column:
    return year - first


def share(part: Column, total: Column) -> Column:
    """part / total where total is above zero, else null."""
    return F.when(total > 0, part / total)


def row_sum(cols: list[Column]) -> Column:
    """The sum of the non-null values; null only if all are null."""
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in cols])
    return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols]))


def distance_bin(d: Column, radii: list[int]) -> Column:
    """Right-closed bins between 0 and the radii, the lowest edge included: '0-100m', '100-200m', ..., 'beyond_<last>m'."""
    out, lo = None, 0
    for r in radii:
        cond, name = (d <= r) & (d >= 0), F.lit(f"{lo}-{r}m")
        out = F.when(cond, name) if out is None else out.when(cond, name)
        lo = r
    return out.when(d > radii[-1], f"beyond_{radii[-1]}m")


def loudness_reduction_pct(d: Column, reduction_db: float = 7.0, ref_m: float = 25.0, ref_db: float = 76.0) -> Column:
    """Drop in perceived loudness at distance d, where 100 is the loudness at ``ref_m``.

    The level falls 6 dB a doubling from ``ref_m``, and 10 dB less are half as loud. Nearer than ``ref_m`` counts as there."""
    level = F.lit(ref_db) - 6 * F.log2(F.greatest(d, F.lit(ref_m)) / ref_m)
    loud = lambda x: 100 * F.pow(F.lit(2.0), (x - ref_db) / 10)
    return loud(level) - loud(level - reduction_db)


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 60e6


def first_match(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    """Ordered classification: the first condition that holds."""
    out = None
    for cond, name in cases:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


#: Month abbreviations of release tags.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def release_tag(tag: Column) -> tuple[Column, Column]:
    """'jul26' to (2026, 7); an invalid tag gives nulls."""
    ok = F.lower(tag).rlike("^(" + "|".join(MONTHS) + r")\d\d$")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(tag, 1, 3)))
    return F.when(ok, 2000 + F.substring(tag, 4, 2).try_cast("int")), F.when(ok, month.cast("int"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, one decimal."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * 6371000 * F.asin(F.sqrt(a)), 1)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95% Wilson interval of a share."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def position_km(value: Column) -> Column:
    """'66+280' to 66280 metres."""
    return F.regexp_extract(value, r"^(\d+)\+(\d+)$", 1).try_cast("int") * 1000 + F.regexp_extract(value, r"^(\d+)\+(\d+)$", 2).try_cast("int")
