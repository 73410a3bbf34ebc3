"""Patterns of the Japanese rules, and the expressions that apply them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from . import text as T
from .rules import JA

# Phrases that follow foreign syntax, each reported from two hits on.
PHRASES = {
    "point that": "という点です",
    "what matters": "重要なのは",
    "here it matters": "ここで重要(?:なのは|になる)",
    "only": "[ぁ-んァ-ヶ一-龥]{2,12}だけは",
    "the fact that": "という事実",
    "notably": "注目すべき",
    "no evidence": "(?:証拠|根拠)[でと]は(?:ない|なら)",
    "supports": "を支持する",
    "merely": "に(?:過ぎ|すぎ)ない",
    "perspective": "(?:の|という)観点",
    "as a result": "結果として",
    "we": "(?:我々|私たち)[はが]",
    "therefore": "(?m)^(?:したがって|従って)",
    "breaks": "(?<!心が|心は)折れ(?:る|た|て(?!い?ない)|ます|ました)",
}

# Replacements of the spelling dictionary, in order; a pattern's groups are named as in Java.
REPLACEMENTS = (
    ("下記の", "次の"),
    ("下記のとおり|下記の通り", "次のとおり"),
    ("上記の", "前述の"),
    ("上記のとおり|上記の通り", "前述のとおり"),
    ("(.{2,8})な感じです", "$1"),
    ("適当な", "適切な"),
    ("色々な|いろいろな", "いくつかの"),
    ("とりあえず|取り敢えず", "まず"),
    ("纏め", "まとめ"),
    ("因みに", "ちなみに"),
    ("一寸", "ちょっと"),
    ("迚も", "とても"),
    ("余り", "あまり"),
    ("旨い", "おいしい"),
    ("することが可能です|することができます", "できます"),
    ("(.{2,10})することが可能です", "$1できます"),
    ("する場合において", "する場合"),
    ("、そのため", "。そのため"),
    ("重要なのは[、]?「?(.{4,40}?[^るいうくすつぬむぶ])」?という点です", "重要なのは$1です"),
    ("重要なのは[、]?「?(.{4,40}?[^るいうくすつぬむぶ])」?ということです", "重要なのは$1です"),
    ("(?:ポイント|要点)は[、]?「?(.{4,40}?[^るいうくすつぬむぶ])」?という点です", "ポイントは$1です"),
    ("重要なのは[、]?「?(.{4,40}?[るいうくすつぬむぶ])」?という点です", "重要なのは$1ことです"),
    ("(?:ポイント|要点)は[、]?「?(.{4,40}?[るいうくすつぬむぶ])」?という点です", "ポイントは$1ことです"),
)

# Titles of notes and diaries; topics of machine learning in a title or tag.
MEMO_TITLE = "備忘録?|自分用メモ|個人用メモ|メモ$|メモ書き|ハンズオン記録|日報|週報|学習記録|作業ログ|やったことリスト"
TOPIC = (
    "(?i)ChatGPT|GPT-?[0-9]|Claude|Gemini|Copilot|LLM|生成AI|生成系AI|プロンプト|RAG|LangChain|Ollama|Cursor|DeepSeek|Devin"
    "|AIエージェント|機械学習|ディープラーニング"
)

# What digits in a title are for; the first that fits.
TITLE_DIGITS = {
    "date": r"20\d{2}[-/年]\d{1,2}[-/月]|\d{1,2}月\d{1,2}日",
    "series": r"第\s*\d+\s*[回話章部]|[(（]\s*\d+\s*[)）]\s*$|\d+\s*回目",
    "version": r"v\.?\d|\d+\.\d+(\.\d+)?|[A-Za-z]\s*\d{1,2}\b(?!つ)",
    "listing": r"\d+\s*(?:つ|個|種類|パターン|ステップ|ポイント)の\S|\d+\s*選|\d+\s*(?:つ|個)\s*[のを]?\s*(?:方法|理由|コツ|技|Tips|ルール|観点|ポイント)",
    "duration": r"\d+\s*(?:分|秒|時間|日)で",
}

# What the look of a quotation says about it.
EMOJI = r"\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2139}\x{2194}-\x{21AA}\x{FE0F}\x{200D}\x{3030}"
SPEAKERS = "ユーザー|User|あなた|私|筆者|AI|アシスタント|Assistant|ChatGPT|GPT|Claude|Gemini|Copilot|Cursor|Devin|エージェント|先輩|後輩"
CALLOUTS = (
    "注意|注記|警告|注|補足|ポイント|メモ|まとめ|結論|前提|免責|用語|学び|観測したこと|受講メモ|検証日|収集日時|つまずきポイント|注意事項|セキュリティ注記"
    "|NOTE|Note|TIP|Tips?|WARNING|Warning|CAUTION|IMPORTANT"
)
SPEAKER = rf"^(?:[{EMOJI}]+\s*[:：]|[{EMOJI}]+\s*\*{{0,2}}[^\n:：]{{1,14}}\*{{0,2}}\s*\n\s*[「\"]|(?:\*\*)?(?:{SPEAKERS})(?:\*\*)?\s*[:：])"
CALLOUT = (
    rf"^(?:[{EMOJI}]+\s*)?(?:\*\*|【)?(?:{CALLOUTS})[^\n]{{0,12}}?(?:\*\*|】)?\s*[:：]|^(?:[{EMOJI}]+\s*)?(?:\*\*|【)(?:{CALLOUTS})[^\n]{{0,12}}?(?:\*\*|】)"
    rf"|^※|^[{EMOJI}]+\s*\S|^【[^】\n]{{1,16}}】|^\*\*[^*\n]{{1,20}}[:：]?\*\*\s*[:：]?\s*(?:\n|$)|^\*\*[^*\n]{{1,20}}\*\*\s*[:：]"
)
SOURCE = r"(?:^|\n)\s*(?:[—–]{1,2}|出典|引用元|元記事|参考|via)\s*[:：]?\s*\S"
SHELL = r"^[$#]\s|^\s*(?:\w+@|C:\\|/usr/|npm |pip |sudo |git )"
ERROR = r"Error|error|Exception|Traceback|warning:|WARN|FATAL|Status Code:|\bE\d{3,}\b|CS\d{4}|\bexit code\b"
LETTER = "[ぁ-んァ-ヶ一-龥]"

# Blocks that count as Japanese, links and images.
BLOCK_CHARS, BLOCK_SHARE = 20, 0.30
IMAGE_URL, HTML_IMAGE_URL = r"!\[[^\]]*\]\(([^)\s]+)", r"(?i)<img\s[^>]*src=[\"']([^\"']+)"
LINK_URL, BARE_URL = r"\[[^\]]*\]\((https?://[^)\s]+)\)", r"(?<![(\]])https?://[^\s)]+"
IMAGE_MARK, QUOTE_MARK = r"(?i)!\[[^\]]*\]\(|<img\s", r"(?m)^\s{0,3}>\s"
BLOCK_LETTER = "[\u3040-\u30ff\u4e00-\u9fff]"

# Sentences that end in a noun for another reason than style.
OPEN_TAIL = "[:：\\-—ー…]$"
FRAGMENT = r"^\s*(?:#{1,6}\s*|[-*+・]\s*|\d+[.)]\s*|[①-⑳]\s*|※\s*|>+\s*)"
CODE_SIGN = r"[=;{}()\[\]<>]|//|/\*|\*/"
SETTING = "[:：|｜]"
CHAPTER = "[【】〜]|^第[０-９0-9一二三四五六七八九十]+[章節部]"
PARTICLE = "^[はがをにでとへやのも、。]"
NO_NOUN = r"[\dA-Za-z_.\-]+"
LEAST_MORA = 8


def exclusion_reason(clean: Column, body: Column, title: Column, private: Column, slide: Column) -> Column:
    """The first reason to leave an article out, or null. ``clean``: its cleaned prose, ``body``: its whole text."""

    def reason(z: Column) -> Column:
        chars, letters = z["chars"], z["letters"]
        return (
            F.when(private, "private").when(slide, "slide_mode").when(~F.coalesce(body.rlike("(?U)\\S"), F.lit(False)), "empty_body")
            .when(chars < R.MIN_CHARS, "short_body").when(letters < R.MIN_SHARE * chars, "other_script").when(letters < R.MIN_LETTERS, "few_letters")
            .when(z["kana"] < R.MIN_KANA * chars, "low_kana").when(title.rlike(MEMO_TITLE), "memo_post")
        )

    return T.let(F.struct(T.solid_length(clean).alias("chars"), T.count_of(clean, JA.letters).alias("letters"), T.count_of(clean, JA.kana).alias("kana")), reason)


def about_topic(title: Column, tags: Column) -> Column:
    """Whether the title or a tag names the topic."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(tags, " ")).rlike(TOPIC)


def title_use(title: Column) -> Column:
    """What the digits of a title are for; null without digits."""
    out = F.when(~title.rlike(r"\d"), F.lit(None))
    for name, pattern in TITLE_DIGITS.items():
        out = out.when(title.rlike(pattern), name)
    return out.otherwise("other")


def quote_kind(block: Column) -> Column:
    """Kind of a block of quotation; the first that fits."""
    head = F.substring(F.ltrim(block), 1, 80)
    return (
        F.when(head.rlike(SPEAKER), "dialogue").when(head.rlike(CALLOUT), "callout").when(block.rlike(ERROR), "error").when(head.rlike(SHELL), "code")
        .when(block.rlike(SOURCE) | block.rlike("https?://"), "sourced").when(~block.rlike(LETTER) & (F.length(block) > 20), "foreign").otherwise("plain")
    )


def needed(pattern: str) -> str:
    """What stands in every hit of a pattern that begins with any letters, which are slow to look for; else nothing."""
    found = re.fullmatch(r"(?:\(\.\{\d+,\d+\}\)|\[[^\]]+\]\{\d+,\d+\})(\w+)", pattern)
    return found[1] if found else ""


def is_nominal(sentence: Column, tokens: Column) -> Column:
    """Whether a sentence of prose ends in a noun as a matter of style. ``tokens``: those of the sentence without its stop.
    The noun is asked for first, as most sentences have none and need no look at their letters then."""
    last = F.get(tokens, F.size(tokens) - 1)
    noun = (last["pos1"] == "名詞") & ~last["surface"].rlike(f"^(?:{NO_NOUN})$")
    return F.when(noun, F.coalesce(T.let(F.trim(F.regexp_replace(sentence, "[。！？!?]+$", "")), _is_prose), F.lit(False))).otherwise(False)


def _is_prose(bare: Column) -> Column:
    """Whether what stands before a stop is no heading, item, code, setting or fragment."""
    solid = F.length(F.regexp_replace(bare, " ", ""))
    return (
        (bare != "") & ~bare.rlike(OPEN_TAIL) & ~bare.rlike(FRAGMENT) & (T.mora(bare) >= LEAST_MORA) & (T.count_of(bare, CODE_SIGN) < 2)
        & ~bare.rlike(SETTING) & ~bare.rlike(CHAPTER) & ~bare.rlike(PARTICLE) & (T.count_of(bare, "[!-~]") <= 0.5 * solid)
    )


def dialect_share(text: Column) -> Column:
    """Share of Japanese letters of a block."""
    return T.count_of(text, BLOCK_LETTER) / F.nullif(F.length(text), F.lit(0))


#: Floors of the raw pre-filters, in characters.
RAW_FLOOR, CLEAN_FLOOR, SOLID_FLOOR = 1000, 300, 300


def prefilters(clean: Column, body: Column, private: Column, slide: Column) -> dict[str, Column]:
    """Which documents are looked at before any measure: for checks of words, by length of body and prose; for
    vocabularies, neither private nor slides, with a body and enough characters that are no white space."""
    return {
        "word_check": (F.length(body) >= RAW_FLOOR) & (F.length(clean) >= CLEAN_FLOOR),
        "vocabulary": ~private & ~slide & (F.trim(body) != "") & (T.solid_length(clean) >= SOLID_FLOOR),
    }
