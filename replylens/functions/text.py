"""Text expressions. All are native, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space without the line feed, and word characters. Spelled out because
# regex dialects differ on what \s and \w mean beyond ASCII.
BLANK = (
    r"\t\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = r"\n" + BLANK
WORD = r"\p{L}\p{N}_"

URL_PATTERN = rf"https?://[^{SPACE}]+"
HANDLE_PATTERN = rf"@[{WORD}]+"
SPACES_PATTERN = rf"[{SPACE}]+"
# the runs that collapsing changes; a single blank is already right
UNEVEN_SPACES = rf"[{SPACE}]{{2,}}|[{SPACE.replace(' ', '')}]"
TURN_LINE = rf"(?m)(?d)^[{BLANK}]*(Customer|Support):[{BLANK}]?(.*?)[{BLANK}]*$"
TURN_COUNT = r"(?m)(?d)^(?:Customer|Support):"
SIGN_OFF = rf"[{SPACE}]?[\^/][A-Z]{{2,3}}\.?$"
TOKEN_PATTERN = rf"[{WORD}]{{2,}}"
WORD_PATTERN = rf"[{WORD}]+"
CLAIM_PATTERN = (
    rf"\$\p{{Nd}}[\p{{Nd}},.]*|\b\p{{Nd}}+%|\b\p{{Nd}}+[{SPACE}]?[{WORD}]+"
)


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(text: Column) -> Column:
    """Delete links, then @handles, then collapse white space. The order matters:
    a handle inside an e-mail address goes too."""
    no_links = F.regexp_replace(text, URL_PATTERN, "")
    no_handles = F.regexp_replace(no_links, HANDLE_PATTERN, "")
    return F.trim(F.regexp_replace(no_handles, UNEVEN_SPACES, " "))


def transcript_turns(conversation: Column) -> Column:
    """Array of (role, text) for the lines that carry a role prefix, in order.

    Lines without the prefix are dropped, so of a multi-line turn only the first
    line stays. Both groups come from the same pattern, so the arrays align.
    """
    roles = F.regexp_extract_all(conversation, F.lit(TURN_LINE), F.lit(1))
    texts = F.regexp_extract_all(conversation, F.lit(TURN_LINE), F.lit(2))
    return F.arrays_zip(roles.alias("role"), texts.alias("text"))


def has_support_reply(conversation: Column) -> Column:
    return conversation.startswith("Support:") | conversation.contains("\nSupport:")


def turn_count(conversation: Column) -> Column:
    return F.regexp_count(conversation, F.lit(TURN_COUNT))


def strip_sign_off(reply: Column) -> Column:
    """Remove a trailing agent tag such as ^AB or /AB."""
    return trim_spaces(F.regexp_replace(reply, SIGN_OFF, ""))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES_PATTERN), lambda word: word != "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words, counted without building them."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+"))


def is_fragment(text: Column, max_words: int = 5) -> Column:
    return word_count(text) <= max_words


def reply_length_ok(reply: Column, low: int = 10, high: int = 80) -> Column:
    return word_count(reply).between(low, high)


def word_set(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    )


def overlap_score(reply: Column, evidence: Column) -> Column:
    """Share of the reply's distinct words that occur in the evidence."""
    words = word_set(reply)
    shared = F.size(F.array_intersect(words, word_set(evidence)))
    return shared / F.greatest(F.size(words), F.lit(1))


def unsupported_claims(reply: Column, evidence: Column) -> Column:
    """Distinct amounts, percentages and counted things in the reply that the
    evidence text does not contain (case ignored)."""
    claims = F.array_distinct(
        F.regexp_extract_all(reply, F.lit("(?U)" + CLAIM_PATTERN), F.lit(0))
    )
    lowered = F.lower(evidence)
    return F.filter(claims, lambda claim: ~F.contains(lowered, F.lower(claim)))


def duplicate_key(text: Column) -> Column:
    return trim_spaces(F.lower(text))


def near_duplicate_key(text: Column) -> Column:
    """Lower case with everything but letters, digits and white space removed."""
    return F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{SPACE}]", "")


def preview(text: Column, length: int = 80) -> Column:
    return F.substring(text, 1, length)


def stable_pair_id(conversation_id: Column, position: Column) -> Column:
    """Id that depends on the pair alone, so no global numbering is needed."""
    key = F.concat(conversation_id.cast("string"), F.lit(":"), position.cast("string"))
    return F.concat(F.lit("p_"), F.md5(key))
