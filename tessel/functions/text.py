"""Text expressions: tokens, stems, cleaning, URLs. All are built-in Catalyst expressions unless a docstring says otherwise."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to lower case or to another letter, and dashes that fold to the hyphen.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁё‐‑‒–—"
FOLD_TO = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяее-----"

# A token has letters of one script; with numbers, digits may follow or stand first; single hyphens join.
WORDS = "[a-z]+(?:-[a-z]+)*|[а-я]+(?:-[а-я]+)*"
WORDS_AND_NUMBERS = "[a-z][a-z0-9]*(?:-[a-z0-9]+)*|[а-я][а-я0-9]*(?:-[а-я0-9]+)*|[0-9][a-zа-я0-9]*(?:-[a-zа-я0-9]+)*"

# Endings that the stemmer removes, longest first; at least three characters stay.
ENDINGS = [
    "иями", "ями", "ами", "ыми", "ими", "ого", "ему", "ому",
    "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ая", "яя", "ою", "ею", "ую", "юю", "ам", "ям", "ах", "ях", "ом", "ем",
    "а", "я", "ы", "и", "о", "е", "у", "ю", "ь",
]
STEM = f"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$"

# Titles with these words before the first colon are service pages.
SERVICE_PREFIXES = ["Википедия", "Wikipedia", "Обсуждение", "Участник", "Шаблон", "Template", "Файл", "File", "Категория", "Category", "Портал", "Проект", "Справка", "MediaWiki", "Модуль"]

# White space as a Unicode-aware regular expression of the reference's language sees it.
SPACES = r"(?U)[\s\x1c-\x1f]+"


@dataclass(frozen=True)
class TokenOptions:
    """keep_numbers: digits count as token characters. min_len: in characters, before stemming."""

    keep_numbers: bool = False
    stem: bool = False
    min_len: int = 1

    @property
    def pattern(self) -> str:
        return WORDS_AND_NUMBERS if self.keep_numbers else WORDS


DEFAULT = TokenOptions()


def fold(text: Column) -> Column:
    """Lower case of the two alphabets, е for ё, and one hyphen for all dashes; other characters stay."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def raw_tokens(text: Column, options: TokenOptions = DEFAULT) -> Column:
    """Tokens of at least min_len characters, before stemming. Nothing follows a token in its pattern, so no repeat ever
    has to give characters back; said in the pattern, matching takes a quarter less time."""
    found = F.regexp_extract_all(fold(text), F.lit(re.sub("([+*])", r"\1+", options.pattern)), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= options.min_len) if options.min_len > 1 else found


def stem(token: Column) -> Column:
    return F.regexp_replace(token, STEM, "$1")


def tokens(text: Column, options: TokenOptions = DEFAULT) -> Column:
    found = raw_tokens(text, options)
    return F.transform(found, stem) if options.stem else found


def query_terms(text: str, options: TokenOptions = DEFAULT) -> list[str]:
    """The same tokens of a short string, on the driver."""
    found = [t for t in re.findall(options.pattern, text.translate(str.maketrans(FOLD_FROM, FOLD_TO))) if len(t) >= options.min_len]
    return [re.sub(STEM, r"\1", t) for t in found] if options.stem else found


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


# Patterns that must match what the cleaned texts are compared with, and what stands in their place.
POST_MARKS = [(r"(?s)<code>.*?</code>", " [код] "), (r"(?s)<pre>.*?</pre>", " [блок кода] "), (r"<[^>]+>", "")]
POST_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")]
MARKUP = [
    (r"\{\{[^}]+\}\}", ""),
    (r"(?iu)\[\[(?:Файл|File|Image):[^\]]+\]\]", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
    (r"\[https?://[^\]]+\]", ""),
    (r"<[^>]+>", ""),
    (r"'{2,}", ""),
]
#: Elements whose text is no text of the page, and those that hold code.
UNSEEN, CODE = frozenset(("script", "style", "template")), frozenset(("pre", "code"))


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def clean_post(text: Column) -> Column:
    """Post markup to text: code and blocks become marks, tags go, five entities are decoded in turn."""
    marked = _replaced(F.coalesce(text, F.lit("")), *POST_MARKS)
    for entity, char in POST_ENTITIES:
        marked = F.replace(marked, F.lit(entity), F.lit(char))
    return squeeze(marked)


def clean_markup(text: Column) -> Column:
    """Encyclopedia markup to text, by the rules of the dump extractor."""
    return squeeze(_replaced(F.coalesce(text, F.lit("")), *MARKUP))


class _Text(HTMLParser):
    """Text between tags, stripped, without what stands inside the tags to skip."""

    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.parts = skip, 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.skip

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.skip and self.depth > 0

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data.strip())


def html_text(raw: str | None, keep_code: bool = False) -> str:
    """Entities decoded, then the text of the markup, parts joined by spaces; scripts, styles and templates are left out,
    and pre and code unless kept."""
    if not raw:
        return ""
    parser = _Text(UNSEEN if keep_code else UNSEEN | CODE)
    parser.feed(html.unescape(raw))
    parser.close()
    return re.sub(r"\s+", " ", " ".join(p for p in parser.parts if p)).strip()


def clean_html(text: Column, keep_code: bool = False) -> Column:
    """html_text in Arrow batches: markup needs a parser and the full entity table, which no built-in has."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: html_text(x, keep_code))

    return run(text)


def unescape(text: Column) -> Column:
    """The full table of entities, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: html.unescape(x) if x else x)

    return run(text)


def clean_article(text: Column) -> Column:
    """Article markup to text by the crawler's rules: entities first, then comments, galleries, references, links with
    labels, files and categories, and last templates, links, tags, tables and quotes. Tables and nested templates are
    taken from the inside out, up to four deep; the entities need Arrow batches, the rest is built in."""
    plain = _replaced(
        unescape(F.coalesce(text, F.lit(""))),
        (r"(?s)<!--.*?-->", " "),
        (r"(?is)<gallery\b[^>]*>.*?</gallery\s*>", " "),
        (r"(?is)<ref\b[^>/]*>.*?</ref\s*>", " "),
        (r"(?i)<ref\b[^>]*/\s*>", " "),
        (r"\[https?://[^\s\]]+\s*\]", " "),
        (r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),
        (r"(?iu)\[\[(?:Файл|File|Image):[^\]]+\]\]", " "),
        (r"(?iu)\[\[(?:Категория|Category):[^\]]+\]\]", " "),
        *[(r"\{\{[^{}]*\}\}", "")] * 4,
        (r"(?s)\{\|.*?\|\}", ""),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
        (r"<[^>]+>", ""),
        (r"'{2,}", ""),
        (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"),
    )
    return squeeze(plain)


def decode_url(text: Column) -> Column:
    """Percent escapes to bytes, underscores to spaces; plus stays, and so does a percent sign that starts no escape."""
    spaced = F.replace(F.translate(text, "_", " "), F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_replace(spaced, "%(?![0-9A-Fa-f]{2})", "%25"))


def encode_url(text: Column) -> Column:
    """Percent escapes as in a path: letters, digits and _.-~/ stay."""
    coded = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def title_of_url(url: Column) -> Column:
    return decode_url(F.regexp_extract(url, r"/wiki/([^?#]*)", 1))


def display_title(title: Column, url: Column) -> Column:
    """The title, else the one in the URL, else the URL; a missing URL is empty."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(title), filled(title_of_url(url)), url, F.lit(""))


def is_service_page(title: Column) -> Column:
    return F.contains(title, F.lit(":")) & F.substring_index(title, ":", 1).isin(*SERVICE_PREFIXES)


def split_tags(tags: Column) -> Column:
    """<a><b> as an array."""
    return F.regexp_extract_all(tags, F.lit("<([^>]+)>"), F.lit(1))
