"""Patterns and constants of the text rules, for Japanese and for Latin scripts."""

from __future__ import annotations

from dataclasses import dataclass

# Line and inline patterns of Markdown as the metrics read it.
FENCE = r"^\s*(```|~~~)"
HEADING = r"^\s{0,3}(#{1,6})\s"
LIST_ITEM = r"^(\s*)([-*+]|\d+[.)])\s+"
TABLE_ROW = r"^\s*\|"
QUOTE = r"^\s*>"
BOLD = r"\*\*[^*\n]+\*\*|__[^_\n]+__"
INLINE_CODE = r"`[^`\n]+`"
ENGLISH = r"[A-Za-z][A-Za-z0-9_.-]*"
LINK = r"\[([^\]]*)\]\([^)]*\)"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
HTML_TAG = r"<[^>]+>"
EMPHASIS = r"\*\*|__|\*|~~"

# Exclusion floors and scales.
MIN_CHARS, MIN_SENTENCES, MIN_SHARE, MIN_LETTERS, MIN_KANA, FULL_WEIGHT = 300, 5, 0.30, 200, 0.12, 30
MTLD_FACTOR, MTLD_TOKENS = 0.72, 50
SLOPE_CUTOFF = 0.05


@dataclass(frozen=True)
class Rules:
    """What a script's punctuation and endings look like; patterns are Java regular expressions."""

    stops: str
    commas: str
    dash: str
    ideograph: str
    letters: str
    kana: str
    polite: str
    plain: str
    closing: str
    word: str


# What Japanese punctuation, letters and endings are to the metrics.
JA = Rules(
    stops="。！？!?", commas="、，", dash="—|――", ideograph="[一-鿿]", letters="[぀-ゟ゠-ヿ一-鿿]", kana="[぀-ゟ゠-ヿ]",
    polite="(です|ます|ました|ません|でしょう)[。！？]?$", plain="(である|だ|った|ない)[。！？]?$", closing="まとめ|おわりに|終わりに|最後に|結論", word="[一-鿿぀-ゟ゠-ヿ]+|[A-Za-z]+",
)
LATIN = Rules(
    stops=".!?", commas=",", dash="—|--", ideograph="[A-Z]", letters="[A-Za-zÀ-ÿ]", kana="[a-zà-ÿ]",
    polite="(ed|ing)[.!?]?$", plain="(er|on)[.!?]?$", closing="(?i)summary|conclusion", word="[A-Za-zÀ-ÿ]+",
)
