"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def non_blank(text: Column) -> Column:
    """More than spaces."""
    return F.length(F.trim(text)) > 0


def contains_folded(text: Column, needle: str) -> Column:
    """Literal substring, case folded."""
    return F.instr(F.lower(text), needle.lower()) > 0


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def plain_key(text: Column) -> Column:
    """Without any white space: two quotes that differ in spacing only have one key."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def html_escaped(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def marked_only(text: Column) -> Column:
    """Escaped, but for <mark> and </mark>."""
    text = html_escaped(text)
    return F.replace(F.replace(text, F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def snippet(text: Column, needle: str, around: int = 40) -> Column:
    """The first hit between marks, with up to `around` characters on both sides; the opening where there is no hit."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(F.lit(1), at - around)
    hit = F.concat(F.substring(text, start, at - start), F.lit("<mark>"), F.substring(text, at, F.lit(len(needle))), F.lit("</mark>"), F.substring(text, at + len(needle), F.lit(around)))
    return F.when(at > 0, hit).otherwise(F.substring(text, 1, 2 * around))


def term_runs(text: Column) -> Column:
    """Runs of ideographs, of two or more katakana, and latin words, in text order (array)."""
    return F.regexp_extract_all(text, F.lit(r"[一-龯々〆ヵヶ]+|[ァ-ヺー]{2,}|[A-Za-z0-9][A-Za-z0-9_.\-]*"), F.lit(0))


def distinct_folded(terms: Column, most: int) -> Column:
    """The first spelling of each case-folded term, `most` of them at most. Terms and their folded forms are bound once, and
    only the kept terms are looked up, so that the work grows with the number of terms."""

    def first_spellings(bound: Column) -> Column:
        kept = F.slice(F.filter(F.array_distinct(bound["low"]), lambda k: k.isNotNull()), 1, most)
        return F.transform(kept, lambda k: F.element_at(bound["terms"], F.array_position(bound["low"], k).cast("int")))

    bound = F.struct(terms.alias("terms"), F.transform(terms, lambda t: F.lower(t)).alias("low"))
    return F.transform(F.array(bound), first_spellings)[0]


def lane(text: Column) -> Column:
    """'en' with 20 latin letters or more that are over four times the Japanese characters, else 'ja'."""
    latin, other = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[぀-ヿ一-鿿]"))
    return F.when((latin >= 20) & (latin > 4 * other), "en").otherwise("ja")


def mostly_latin(text: Column, share: float = 0.7) -> Column:
    """Latin letters and digits make up `share` of what is not white space; an empty text is not."""
    seen = F.length(plain_key(text))
    return F.coalesce((seen > 0) & (F.regexp_count(text, F.lit("[A-Za-z0-9]")) / F.nullif(seen, F.lit(0)) >= share), F.lit(False))


def file_key(name: Column) -> Column:
    """Base name without folder and extension, letters and digits only, lower-cased."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(base, r"[^\p{L}\p{N}]", ""))


def safe_stem(name: Column) -> Column:
    """A file stem: illegal characters become _, trailing dots and spaces go, reserved names get a leading _."""
    s = F.regexp_replace(F.regexp_replace(name, r"[<>:\"/\\|?*\x00-\x1f]", "_"), r"[. ]+$", "")
    s = F.when(F.upper(s).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.length(s) == 0, "document").otherwise(F.substring(s, 1, 120))


def logical_text(text: Column) -> Column:
    """Without page headers, page tokens such as [P3], heading marks, note tokens and control characters."""
    for pattern in (r"(?m)^--- page \d+ ---$\n?", r"\[P\d+\]", r"(?m)^#{1,6} ", r"\[\^?(?:note|fn)?\d+\]", r"[\x00-\x08\x0b\x0c\x0e-\x1f]"):
        text = F.regexp_replace(text, pattern, "")
    return text


def unwrapped(text: Column) -> Column:
    """Western line unwrapping: a hyphen between letters at a line end joins, other single line ends become a space."""
    text = F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")
    return F.regexp_replace(text, r"([^\n])\n(?!\n)", "$1 ")


def year_token(text: Column) -> Column:
    """Four-digit years written with full-width digits or inner spaces, with plain digits."""
    text = F.translate(text, "０１２３４５６７８９", "0123456789")
    return F.regexp_replace(text, r"(?<!\d)([12]) ?(\d) ?(\d) ?(\d)(?= ?年)", "$1$2$3$4")


def joined_cell(parts: Column) -> Column:
    """Cell pieces joined, with a space only between two ASCII letters or digits."""
    edge = "[A-Za-z0-9]"
    glue = lambda a, b: F.when(a.rlike(f"{edge}$") & b.rlike(f"^{edge}"), F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))
    return F.aggregate(parts, F.lit(""), glue)


def markdown_row(cells: Column) -> Column:
    """A table row; bars are escaped and line feeds become <br>."""
    clean = F.transform(cells, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def overlap_join(a: Column, b: Column, least: int = 8) -> Column:
    """a and b joined over the longest suffix of a that is a prefix of b, of `least` characters or more; else a, b."""
    sizes = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: (n >= least) & (F.right(a, n) == F.left(b, n)))
    n = F.coalesce(F.array_max(sizes), F.lit(0))
    return F.concat(a, F.when(n < F.length(b), F.substring(b, n + 1, F.length(b))).otherwise(F.lit("")))


def cjk_tight(text: Column) -> Column:
    """Spaces between two CJK characters, or between one and CJK punctuation, go."""
    cjk, punct = "一-鿿぀-ヿ々〆", "、。，．・：；？！「」『』（）〔〕［］【】…―ー"
    return F.regexp_replace(text, rf"(?<=[{cjk}{punct}])[ 　]+(?=[{cjk}])|(?<=[{cjk}])[ 　]+(?=[{punct}])", "")


def unlooped(text: Column) -> Column:
    """Runaway repetition: a character four times or more, and a phrase of 2 to 20 characters three times or more in a row, become
    one; runs of digits, decimals and white space stay."""
    text = F.regexp_replace(text, r"([^0123456789 \t\n\x0B\f\r.\-=_*#|])\1{3,}", "$1")
    # A phrase counts only if its line goes on with something else than these; the tail of a line that is nothing else is
    # passed over as a whole. Four characters that come again within 20 are looked for first: few places need the rest.
    plain = r"\d \t\x0B\f\r.,"
    return F.regexp_replace(text, rf"(?:\G|(?<![{plain}]))([{plain}]++(?![^\n]))|(?=([^\n]{{4}}))(?=[^\n]{{2,20}}?\2)(([^\n]{{2,20}}?)\4{{2,}})", "$1$4")


#: Phrases a recogniser is known to repeat, with their plain forms.
KNOWN_LOOPS = (("だがプーチンは、だがプーチンは、", "だがプーチンは、"), ("どうしようもないと言うようもないと言うように", "どうしようもないと言うように"))
#: Digits and ideographs that are numbers, as a part of a character class. The single ideographs are only asked for within
#: their range: a class asks all its members one by one.
_NUMBER = r"\p{N}[㐀-鿿&&[" + "".join(c for c in map(chr, range(0x3400, 0xA000)) if c.isnumeric()) + "]]"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _where(text: Column, asked: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """The changed text where it can change: a cheap question before dear patterns."""
    return _bound(text, lambda t: F.when(asked(t), change(t)).otherwise(t))


#: White space of Unicode, as (?U)\s has it.
_SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


# The patterns and counts of clean_line, clean_read and clean_region below, and their order, decide the results.
def _year_brackets(text: Column) -> Column:
    """A closing bracket behind a year that was read as l or 1."""
    for read in ("l", "1"):
        text = _where(text, lambda t, read=read: F.contains(t, F.lit(f"{read}.")), lambda t, read=read: F.regexp_replace(t, rf"(?U)(\b\d{{4}}[a-z]?){read}\.", "$1]."))
    return text


def _word_loop_cut(text: Column, times: int, numbers: bool) -> Column:
    """A last line that repeats a word `times` times or more ends there; words that hold a number may repeat unless `numbers`."""
    again = f"{{{times - 1},}}"
    if numbers:
        return F.regexp_replace(text, rf"(?Ud)(\b\w+\b\s+)\1{again}.*$", "")
    return F.regexp_replace(text, rf"(?Ud)(\b[\w&&[^{_NUMBER}]]+\b\s+)\1{again}.*$|((\b\w+\b\s+)\3{again}.*$)", "$2")


def clean_read(text: Column) -> Column:
    """The recogniser's own cleaning of a read: any character but a number three times or more becomes one, the text ends
    at five equal marks (. - _ =), a word three times ends the line, a phrase of 2 to 8 characters three times becomes one."""
    text = F.regexp_replace(text, rf"(?U)([^\s{_NUMBER}])\1{{2,}}", "$1")
    text = _stripped(F.regexp_replace(text, r"(?Us)([.\-_=])\1{4,}.*", ""))
    text = _stripped(_word_loop_cut(text, 3, numbers=False))
    # the longest phrase counts; it is folded only if the part before the same rest of the text is free of numbers
    longest, plain = r"(?=(\S{2,8})(\1{2,}.*))", rf"([^\s{_NUMBER}]{{2,8}})(?=\2\z)\3{{2,}}"
    text = F.regexp_replace(text, rf"(?Us){longest}{plain}|((\S{{2,8}})\5{{2,}})", "$3$4")
    return _year_brackets(text)


def clean_region(text: Column) -> Column:
    """The cleaning of text in regions found by themselves: the last line ends where any character, numbers too, comes five
    times in a row, and where a word comes four times."""
    text = _stripped(F.regexp_replace(text, r"(?Ud)([^\s])\1{4,}.*$", ""))
    return _year_brackets(_stripped(_word_loop_cut(text, 4, numbers=True)))


def clean_line(text: Column, keep_edge_numbers: bool = False, drop_latin_noise: bool = True) -> Column:
    """A recognised line without the marks of a recogniser that ran away. Null stays null.

    Repetition first: a kana or ideograph three times or more becomes one, a line ends where another character comes five
    times, a phrase of 2 to 12 characters three times or more becomes one, four equal words end the line. Numbers may
    repeat: what holds one is matched too, so that nothing inside it is taken for a loop, and put back whole. Then year
    brackets read as l or 1, decimals, braces, and numbers and dashes at the edges (`keep_edge_numbers` keeps those; a number
    before a closing bracket always stays). Lines of brackets and dashes, and long lines without Japanese that look like
    noise, become empty (`drop_latin_noise=False` keeps the latter)."""
    for pattern, by in (
        (rf"([一-龥ぁ-んァ-ヶ&&[^{_NUMBER}]])\1{{2,}}", "$1"),
        (rf"(?Us)([^\s{_NUMBER}])\1{{4,}}.*", ""),
        ("", ""),
        # four characters that come again within 12 are looked for first: few places need the rest
        (rf"(?d)(?=(.{{4}}))(?=.{{2,12}}?\1)(?:([^\n{_NUMBER}]{{2,12}}?)\2{{2,}}|((.{{2,12}}?)\4{{2,}}))", "$2$3"),
    ):
        text = F.regexp_replace(text, pattern, by) if pattern else _stripped(text)
    for loop, plain in KNOWN_LOOPS:
        text = F.replace(text, F.lit(loop), F.lit(plain))
    text = _stripped(_word_loop_cut(text, 4, numbers=False))
    text = _year_brackets(text)

    def without_decimals(text: Column) -> Column:
        for decimals in (r"(?U)(?:[01]\.\d{2,4}[.,]?|\d+[.,]\d{2,}){2,}", r"(?U)(?:\d+[.,]\d+){2,}", r"(?U)(?<!\d)\d+[.,]\d+(?!\d)"):
            text = F.regexp_replace(text, decimals, "")
        return text

    text = F.translate(_where(text, lambda t: t.rlike(r"(?U)[.,]\d"), without_decimals), "{}$", "")

    def edged(text: Column) -> Column:
        brackets = text.rlike(r"(?U)(?:[()\-\s]{3,}\d?){4,}")
        if not keep_edge_numbers:
            item = text.rlike(r"(?U)^\s*[-−―–—－]?\d{2,3}\s*[>〉＞)）]")
            front = lambda t, pattern: F.when(item, t).otherwise(F.regexp_replace(t, pattern, ""))
            text = F.regexp_replace(front(text, r"(?U)^\s*[\d.,\-]+(?=[^\d\s])"), r"(?Ud)(?<=[^\d\s])[\d.,\-]+\s*$", "")
            text = front(text, r"(?U)^\s*[-–—]+\s*")
        return F.regexp_replace(F.when(brackets, "").otherwise(text), r"\.{2,}", "。")

    def without_noise(text: Column) -> Column:
        latin = text.rlike(r"(?Ui)\b(?:the|and|for|with|ton|tion|stand)\b") | text.rlike(r"(?Ud)^[a-zA-Z\s.,\-_]+$")
        return F.when((F.length(text) > 15) & ~text.rlike("[ぁ-ん一-龥]") & latin, "").otherwise(text)

    text = _bound(text, edged)
    return _stripped(_bound(text, without_noise) if drop_latin_noise else text)


def symbol_loop(text: Column) -> Column:
    """A symbol repeated eight times or more makes up half the text or more."""
    run = F.regexp_extract(text, r"([^\w\s])\1{7,}", 0)
    return (F.length(run) > 0) & (2 * F.length(run) >= F.length(plain_key(text)))


def apply_rules(text: Column, rules: list[dict]) -> Column:
    """User rules {pattern, replacement, type: exact or regex, active}: exact ones first, the longest first, then regex ones
    in order."""
    active = [r for r in rules if r.get("active", True) and r.get("pattern")]
    for r in sorted((r for r in active if r.get("type", "exact") == "exact"), key=lambda r: -len(r["pattern"])):
        text = F.replace(text, F.lit(r["pattern"]), F.lit(r.get("replacement", "")))
    for r in (r for r in active if r.get("type") == "regex"):
        text = F.regexp_replace(text, r["pattern"], r.get("replacement", ""))
    return text


def display_weight(text: Column) -> Column:
    """ASCII characters count 1, others 2."""
    return (2 * F.length(text) - F.regexp_count(text, F.lit(r"[\x00-\x7f]"))).cast("int")


def heading_like(text: Column) -> Column:
    """Numbered, lettered or chapter headings by their opening."""
    return (F.length(text) <= 60) & text.rlike(r"^(第[一二三四五六七八九十百0-9]+[章節部編]|\d+(\.\d+)*[. ]\S|[IVX]+\. |Chapter \d+|Section \d+)") & ~text.rlike("[。．.!?]$")
