"""String rules as column expressions: normalising, language heuristics, ids, links, acronym initials, disguises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark Indonesian and English, and openers that decide at once.
ID_MARKERS = ["yang", "dan", "untuk", "ini", "itu", "adalah", "dengan", "di", "ke", "dari", "atau", "akan", "sudah", "bisa", "saya", "kami", "kita", "mereka", "apa", "bagaimana", "kenapa", "mengapa", "kapan", "dimana", "siapa", "mau", "tidak", "bukan", "juga", "hanya", "agar", "karena", "kepada", "pada", "menjadi", "telah", "merupakan", "seperti", "sebagai", "dapat", "cara", "tentang", "oleh", "selama", "setelah", "sebelum"]
EN_MARKERS = ["the", "and", "for", "this", "that", "is", "are", "was", "were", "with", "of", "our", "your", "their", "what", "how", "why", "when", "where", "who", "can", "do", "does", "did", "will", "would", "should", "could", "has", "have", "had", "not", "a", "an", "to", "from", "in", "on", "at", "by", "as", "or", "if"]
ID_OPENERS = ["apa ", "bagaimana ", "bagaiman", "kenapa ", "mengapa ", "kapan ", "dimana ", "di mana ", "siapa ", "tolong ", "saya ", "boleh ", "berapa ", "yang mana ", "halo ", "selamat ", "mohon "]
EN_OPENERS = ["what is ", "what are ", "what does ", "how to ", "how do ", "how does ", "how can ", "why ", "when ", "where ", "who ", "can you ", "could you ", "please ", "tell me ", "explain ", "give me ", "show me "]
ITEM_MARKERS = ["yang", "untuk", "dengan", "tidak", "saya", "kami", "kita", "sudah", "akan"]
REFUSAL_ID_MARKERS = ["yang", "dan", "untuk", "ini", "adalah"]
REFUSAL_EN_MARKERS = ["the", "and", "for", "this", "is"]
REFUSALS = {"en": "I couldn't find a confident answer in the docs.", "id": "Saya tidak menemukan jawaban yang meyakinkan di dokumen."}
# Words that do not count for an acronym's initials.
STOP_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "atau", "dan", "dari", "di", "ke", "pada", "untuk", "yang", "der", "die", "das", "und", "von", "zu", "im", "de", "des", "du", "et", "la", "le", "les", "un", "une"]
# Invisible characters, and look-alikes with the Latin letters they stand for.
INVISIBLE = "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF]))
LOOKALIKES = "аеорсухАВЕКМНОРСТХαειορτυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "aeopcyxABEKMHOPCTXaeioptuvABEZHIKMNOPTYX"
# Enclosed letters, from their code ranges.
ENCLOSED = "".join(chr(base + i) for base in (0x1F1E6, 0x24B6, 0x1F130) for i in range(26)) + "".join(chr(0x24D0 + i) for i in range(26))
OPENED = "".join(map(chr, range(65, 91))) * 3 + "".join(map(chr, range(97, 123)))
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def stripped(c: Column) -> Column:
    """Without white space at both ends, whatever its kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it occurs in the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A Python function that the optimizer must not put in two places, as a filter and a result would have it."""
    return udf.asNondeterministic()


def _between_blanks(c: Column) -> Column:
    """array<string> of what stands between blanks. Of equal neighbours each second one goes, as they share a blank."""
    single = F.regexp_replace(c, r"(?<= )([^ ]+) \1(?= )", "$1")
    return bound(F.split(single, " "), lambda t: F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0))))


def _how_many(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def marker_count(c: Column, words: list[str]) -> Column:
    """How often the words occur between blanks, each counted without overlaps."""
    return _how_many(_between_blanks(c), words)


def _opens(start: Column, openers: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(o) for o in openers]), lambda o: F.startswith(start, o))


def site_language(text: Column) -> Column:
    """'en' or 'id' of a page or question: openers decide, else markers in the first 2000 characters; ties are 'id'."""

    def decide(sample: Column) -> Column:
        start = F.ltrim(sample)
        more_english = bound(_between_blanks(sample), lambda t: _how_many(t, EN_MARKERS) > _how_many(t, ID_MARKERS))
        return F.when(_opens(start, ID_OPENERS), "id").when(_opens(start, EN_OPENERS) | more_english, "en").otherwise("id")

    sample = F.concat(F.lit(" "), stripped(F.lower(F.substring(text, 1, 2000))), F.lit(" "))
    return F.when(F.coalesce(text, F.lit("")) == "", "id").otherwise(bound(sample, decide))


def item_language(text: Column, default: str = "en") -> Column:
    """'id' if at least two of nine markers occur in a text of 20 characters or more, else the default."""
    marks = F.array(*[F.lit(f" {w} ") for w in ITEM_MARKERS])
    hits = bound(F.lower(text), lambda t: F.size(F.filter(marks, lambda m: F.contains(t, m))))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 20, default).when(hits >= 2, "id").otherwise(default)


def refusal_language(answer: Column) -> Column:
    sample = F.lower(F.substring(answer, 1, 300))
    return bound(_between_blanks(sample), lambda t: F.when(_how_many(t, REFUSAL_ID_MARKERS) > _how_many(t, REFUSAL_EN_MARKERS), "id").otherwise("en"))


def refusal_for(answer: Column) -> Column:
    return F.when(refusal_language(answer) == "id", REFUSALS["id"]).otherwise(REFUSALS["en"])


def normalized(markdown: Column) -> Column:
    """Lines without trailing white space; lines without a word character blank; at most one blank line in a row; one
    newline at the end. Applying it twice changes nothing."""

    def shaped(t: Column, unicode: str) -> Column:
        lines = F.regexp_replace(F.regexp_replace(t, LINE_ENDS, "\n"), unicode + r"[\s&&[^\n]]++(?=\n|\z)", "")
        shown = F.regexp_replace(lines, unicode + r"(?m)^[^\w\n]++$", "")
        joined = F.regexp_replace(shown, r"([ \t]*\n){3,}", "\n\n")
        body = F.regexp_replace(joined, r"^\n+|\n+$", "")
        return bound(body, lambda b: F.when(F.regexp_replace(b, unicode + r"^\s+|\s+$", "") == "", "").otherwise(F.concat(b, F.lit("\n"))))

    # Unicode's classes are slow, and ASCII does not need them
    return bound(markdown, lambda t: F.when(F.octet_length(t) == F.length(t), shaped(t, "")).otherwise(shaped(t, "(?U)")))


def sentences(text: Column) -> Column:
    """array<string>: split after sentence ends before a capital, or at blank lines."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])|\n\n+")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://\S+"), F.lit(0))


def with_title_if_bare_url(body: Column, title: Column) -> Column:
    """A body that is one URL gets the title before it."""
    core = stripped(body)
    bare = F.regexp_like(core, F.lit(r"^https?://\S+$"))
    return F.when(bare, F.concat_ws(" ", F.nullif(stripped(title), F.lit("")), core)).otherwise(body)


def without_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def invisible_count(text: Column) -> Column:
    return F.length(text) - F.length(without_invisible(text))


def latin_for_lookalikes(text: Column) -> Column:
    return F.translate(text, LOOKALIKES, LATIN)


def opened_letters(text: Column) -> Column:
    return F.translate(text, ENCLOSED, OPENED)


def rot13(text: Column) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, low + up, low[13:] + low[:13] + up[13:] + up[:13])


def initials_spell(full_name: Column, acronym: Column) -> Column:
    """Whether the initials of full_name, stop words aside, spell the acronym: equal, longer, or one edit away; the
    first letters must agree."""
    words = F.filter(F.split(full_name, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS))
    letters = F.filter(F.transform(words, lambda w: F.substring(w, 1, 1)), lambda c: F.regexp_like(c, F.lit(r"(?U)\p{L}")))
    initials, acro = F.upper(F.array_join(letters, "")), F.upper(acronym)
    near = F.levenshtein(initials, acro) <= 1
    return (initials != "") & (F.substring(initials, 1, 1) == F.substring(acro, 1, 1)) & (F.startswith(initials, acro) | near)


def content_text(content: Column) -> Column:
    """A chat reply's content as text: a JSON list of strings and blocks gives their texts in a row, all else itself."""
    listed = F.from_json(F.concat(F.lit('{"blocks":'), content, F.lit("}")), "blocks array<string>")
    text_of = lambda b: F.when(F.startswith(F.trim(b), F.lit("{")), F.get_json_object(b, "$.text")).otherwise(b)
    is_list = F.regexp_like(content, F.lit(r"(?s)^\s*\[.*\]\s*$"))
    return F.when(is_list & F.try_parse_json(content).isNotNull(), F.array_join(F.transform(listed.blocks, text_of), "")).otherwise(content)


def with_json_schema(prompt: Column, schema: Column) -> Column:
    """A judge's prompt with the order to answer in JSON of that schema."""
    return F.concat(prompt, F.lit("\n\nReply with ONLY valid JSON that matches this schema. No prose, no markdown fences, no commentary:\n```json\n"), schema, F.lit("\n```"))


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def document_id(label: Column, path: Column) -> Column:
    return F.concat(F.lit("doc:"), label, F.lit(":"), F.substring(F.sha2(path, 256), 1, 12))


def csv_set(setting: Column) -> Column:
    """A comma-separated setting as trimmed, non-empty values."""
    return F.filter(F.transform(F.split(setting, ","), lambda x: F.trim(x)), lambda x: x != "")


def glossary_line(acronym: Column, full_name: Column, gloss: Column) -> Column:
    return F.concat(F.lit("- "), acronym, F.lit(" = "), full_name, F.when(gloss.isNotNull(), F.concat(F.lit(" ("), gloss, F.lit(")"))).otherwise(""))
