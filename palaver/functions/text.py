"""Text expressions: folding, tokens, n-grams, counts, emojis, handles."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .expr import let
from .stopwords import STOPWORDS

# White space as Unicode-aware string splitting defines it.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"

# Emoji code points by range. A base may carry a variation selector or
# a skin tone and may be chained by a zero-width joiner; flags are letter pairs.
EMOJI_BASE = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}-\x{21AA}"
    r"\x{231A}-\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}-\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}\x{2611}"
    r"\x{2614}-\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}-\x{2623}\x{2626}\x{262A}"
    r"\x{262E}-\x{262F}\x{2638}-\x{263A}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265F}-\x{2660}"
    r"\x{2663}\x{2665}-\x{2666}\x{2668}\x{267B}\x{267E}-\x{267F}\x{2692}-\x{2697}\x{2699}"
    r"\x{269B}-\x{269C}\x{26A0}-\x{26A1}\x{26A7}\x{26AA}-\x{26AB}\x{26B0}-\x{26B1}"
    r"\x{26BD}-\x{26BE}\x{26C4}-\x{26C5}\x{26C8}\x{26CE}-\x{26CF}\x{26D1}\x{26D3}-\x{26D4}"
    r"\x{26E9}-\x{26EA}\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}\x{2702}\x{2705}"
    r"\x{2708}-\x{270D}\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}"
    r"\x{2733}-\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}"
    r"\x{2763}-\x{2764}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}-\x{2935}"
    r"\x{2B05}-\x{2B07}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F004}\x{1F0CF}\x{1F170}-\x{1F171}\x{1F17E}-\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}"
    r"\x{1F201}-\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F250}-\x{1F251}"
    r"\x{1F300}-\x{1F321}\x{1F324}-\x{1F393}\x{1F396}-\x{1F397}\x{1F399}-\x{1F39B}"
    r"\x{1F39E}-\x{1F3F0}\x{1F3F3}-\x{1F3F5}\x{1F3F7}-\x{1F4FD}\x{1F4FF}-\x{1F53D}"
    r"\x{1F549}-\x{1F54E}\x{1F550}-\x{1F567}\x{1F56F}-\x{1F570}\x{1F573}-\x{1F57A}\x{1F587}"
    r"\x{1F58A}-\x{1F58D}\x{1F590}\x{1F595}-\x{1F596}\x{1F5A4}-\x{1F5A5}\x{1F5A8}"
    r"\x{1F5B1}-\x{1F5B2}\x{1F5BC}\x{1F5C2}-\x{1F5C4}\x{1F5D1}-\x{1F5D3}\x{1F5DC}-\x{1F5DE}"
    r"\x{1F5E1}\x{1F5E3}\x{1F5E8}\x{1F5EF}\x{1F5F3}\x{1F5FA}-\x{1F64F}\x{1F680}-\x{1F6C5}"
    r"\x{1F6CB}-\x{1F6D2}\x{1F6D5}-\x{1F6D7}\x{1F6DC}-\x{1F6E5}\x{1F6E9}\x{1F6EB}-\x{1F6EC}"
    r"\x{1F6F0}\x{1F6F3}-\x{1F6FC}\x{1F7E0}-\x{1F7EB}\x{1F7F0}\x{1F90C}-\x{1F93A}"
    r"\x{1F93C}-\x{1F945}\x{1F947}-\x{1F9FF}\x{1FA70}-\x{1FA7C}\x{1FA80}-\x{1FA88}"
    r"\x{1FA90}-\x{1FABD}\x{1FABF}-\x{1FAC5}\x{1FACE}-\x{1FADB}\x{1FAE0}-\x{1FAE8}"
    r"\x{1FAF0}-\x{1FAF8}"
)
_ONE = rf"[{EMOJI_BASE}](?:\x{{FE0F}}|[\x{{1F3FB}}-\x{{1F3FF}}])?(?:[\x{{E0020}}-\x{{E007F}}]+)?"
EMOJI = (
    rf"([\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
    rf"|{_ONE}(?:\x{{200D}}{_ONE})*)"
)

# Everything outside the span of emoji parts.
ORDINARY = r"[^#*0-9\x{A9}\x{AE}\x{200D}\x{203C}-\x{1FAFF}\x{E0020}-\x{E007F}]+"


def fold(text: Column) -> Column:
    """Lower case with the curly apostrophe straightened."""
    return F.replace(F.lower(text), F.lit("’"), F.lit("'"))


def split_words(text: Column) -> Column:
    """Words by splitting on everything but letters and apostrophes (may hold '')."""
    return F.split(fold(text), "[^a-z']+")


def found_words(text: Column) -> Column:
    """Words by matching runs of letters and apostrophes."""
    return F.regexp_extract_all(fold(text), F.lit("([a-z']+)"), F.lit(1))


def is_vocabulary(word: Column) -> Column:
    return (F.char_length(word) >= 3) & ~word.isin(*STOPWORDS)


def vocabulary_of(text: Column) -> Column:
    """The vocabulary words of a text, repeats kept, sorted, as one string with spaces between."""
    return F.array_join(F.array_sort(F.filter(split_words(text), is_vocabulary)), " ")


def is_content_word(word: Column) -> Column:
    return ~word.isin(*STOPWORDS)


def ngrams(words: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All n-grams of an array of words, repeats kept."""
    return let(words, lambda w: F.concat(*[_ngrams_of(w, n) for n in sizes]))


def _ngrams_of(words: Column, n: int) -> Column:
    """Each (n - 1)-gram with the word behind it: two arrays are walked side by side, no gram is cut out of the words."""
    grams = words
    for i in range(2, n + 1):
        left = F.greatest(F.size(words) - (i - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, 1, left), F.slice(words, i, left), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WHITESPACE), lambda w: w != ""))


def emojis(text: Column) -> Column:
    """Emojis in order, repeats kept. Runs of ordinary characters are cut first with a short class."""
    candidates = F.regexp_replace(text, ORDINARY, " ")
    return F.regexp_extract_all(candidates, F.lit(EMOJI), F.lit(1))


def text_stats(text: Column) -> dict[str, Column]:
    """Characters, words and emojis; zero for null."""
    zero = F.lit(0)
    return {
        "char_len": F.coalesce(F.char_length(text), zero),
        "word_count": F.when(text.isNull(), zero).otherwise(word_count(text)),
        "emoji_count": F.when(text.isNull(), zero).otherwise(F.size(emojis(text))),
    }


def normalize_handle(raw: Column) -> Column:
    """Lower-case e-mail, or digits without the US country prefix."""
    clean = F.lower(F.trim(raw))
    digits = F.regexp_replace(clean, "[^0-9]", "")
    national = F.when(
        (F.char_length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)
    ).otherwise(digits)
    return F.when(F.instr(clean, "@") > 0, clean).otherwise(national)


def contains_word(text: Column, word: str) -> Column:
    """Whole-word match of a literal word in folded text."""
    quoted = word.lower().replace("\\E", "\\E\\\\E\\Q")
    return fold(text).rlike(rf"\b\Q{quoted}\E\b")


def strip_target(guid: Column) -> Column:
    """Identifier of the message a reaction points at."""
    plain = F.regexp_replace(guid, "^bp:", "")
    slash = F.instr(guid, "/")
    return F.coalesce(
        F.when(slash > 0, guid.substr(slash + F.lit(1), F.char_length(guid))).otherwise(plain), F.lit("")
    )


def group_name(name: Column, chat_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Group "), chat_id.cast("string")))
