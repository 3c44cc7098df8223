"""Text functions as Column expressions: HTML, sentences, words, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages with a word list here, and their most common words.
STOP_WORDS = {
    "en": "a an and are as at be but by for from has he her his i in is it its not of on or she that the they this to was were will with you".split(),
    "de": "auf das dem den der des die ein eine im in ist mit nicht sich und von zu".split(),
    "fr": "au avec dans de des du elle en est et il la le les pour que qui sur un une".split(),
    "es": "al como con de del el en es la las los no para por que se su un una y".split(),
}
# The same for the other languages of the registry that have words between spaces.
MORE_STOP_WORDS = {
    "ca": "a al amb de del el els en és i la les més no o per que se un una".split(),
    "da": "af at de den der det en er et for fra har i ikke med og på som til var".split(),
    "fi": "ei että hän ja joka kun mutta myös ne niin oli on ovat se tai".split(),
    "ha": "a da don ga haka idan ko na ne ta wannan ya yana zai".split(),
    "hi": "और इस एक का की के को तो था थी थे नहीं पर भी में यह से है हैं".split(),
    "hu": "a az azt de egy el és hogy is meg mint nem ne volt".split(),
    "it": "al che con da del della di e gli i il in la le lo non per si sono un una".split(),
    "lt": "ar bet buvo iki ir iš jis kad kaip ne nuo o per su tai yra".split(),
    "nl": "aan als dat de die een en het in is met niet of op te van voor was zijn".split(),
    "no": "av de den det en er et for fra har i ikke med og på som til var".split(),
    "pt": "a ao as com da de do e em na no não o os para por que se um uma".split(),
    "ro": "a al ale ca care cu de din în la mai nu o pe pentru se și un".split(),
    "ru": "а без был в во для до и из к как на не но о от по с то что это".split(),
    "sv": "att av de den det en ett för från har i inte med och på som till var".split(),
    "tr": "bir bu çok da daha de en gibi ile için ki mi ne o ve".split(),
}
# Languages of the registry; those written without spaces.
LANGUAGES = "ca zh da nl en fi fr de ha hi hu it ja lt no pt ro ru es sv tr".split()
LOGOGRAMS = ("zh", "ja")
# The shortest title part that stands for a title; the most text that is searched or split.
TITLE_PART, TEXT_LIMIT = 32, 1 << 20
# The word that stands for a mark between title parts, the marks, and the most characters of a title.
PART_WORD, PART_MARKS, TITLE_CHARS = "SEPSEP", r"(?:- )|[:|]", 1023
# Scripts of the languages without spaces, and the kana that only Japanese has.
_LOGOGRAM, _KANA = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", r"[\p{IsHiragana}\p{IsKatakana}]"
_BLOCKS = "(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|blockquote|section|article|hr)\\b[^>]*>"


def html_strip(html: Column) -> Column:
    """Text of a page: block tags end sentences, other tags go, scripts and the like go with what they hold."""
    out = F.regexp_replace(html, r"(?is)<(script|style|title|noscript|head)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, _BLOCKS, "\n\n"), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("­", ""), ("&shy;", "")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    """Title from the metas of sharing sites, else from the title tag, without a leading ``home``."""
    metas = [F.regexp_extract(html, rf'(?is)<meta[^>]*(?:property|name)=["\']{name}["\'][^>]*content=["\']([^"\']*)["\']', 1) for name in ("og:title", "twitter:title", "dc.title")]
    plain = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    found = F.coalesce(*(F.when(F.trim(m) != "", m) for m in (*metas, plain)), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, r"<[^>]*>", ""), r"\s+", " "), r"(?i)^\s*home(?:page)?\s*[-:|]\s*", ""))


def canonical_link(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?is)<link[^>]*rel=["\']canonical["\'][^>]*href=["\']([^"\']+)["\']', 1), F.lit(""))


def meta_refresh(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r'(?is)<meta[^>]*http-equiv=["\']refresh["\'][^>]*content=["\'][^"\']*url=([^"\']+)["\']', 1)), F.lit(""))


def page_links(html: Column, url: Column | None = None) -> Column:
    """Web addresses that a page's anchors and frames lead to; paths count too where the page's own ``url`` is given."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)(?:href|src)=["\'](https?://[^"\'\s>]+|/[^"\'\s>/][^"\'\s>]*)["\']'), F.lit(1))
    if url is None:
        return F.array_distinct(F.filter(found, lambda u: u.startswith("http")))
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    return F.array_distinct(F.transform(found, lambda u: F.when(u.startswith("/"), F.concat(site, u)).otherwise(u)))


def sentences(text: Column) -> Column:
    """Sentences by end marks and line ends; those without letters or of few ASCII characters go."""
    clean = F.regexp_replace(F.substr(text, F.lit(1), F.lit(TEXT_LIMIT)), r"[ \t\r\f]+", " ")
    parts = F.transform(F.split(clean, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: ~junk_sentence(s) & s.rlike(r"[\p{L}\p{N}]"))


def junk_sentence(s: Column) -> Column:
    """Five or more brackets and braces in runs, or at most five characters, all of them ASCII."""
    return s.rlike(r"(?:[\[\]{}<>]\s*){5,}") | ((F.length(s) <= 5) & s.rlike(r"^[\x00-\x7f]*$"))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'’-]*[\p{L}\p{N}_])?"), F.lit(0))


def drop_stop_words(tokens: Column, language: Column) -> Column:
    """The words that are neither in the English list nor in that of the language; one look at a hashed set for each."""

    def without(stop: list[str]) -> Column:
        return F.filter(tokens, lambda w: ~w.isin(stop))

    out = F.when(F.lit(False), tokens)
    for lang, own in (STOP_WORDS | MORE_STOP_WORDS).items():
        if lang != "en":
            out = out.when(language == lang, without(sorted({*own, *STOP_WORDS["en"]})))
    return out.otherwise(without(STOP_WORDS["en"]))


def guess_language(text: Column) -> Column:
    """The language whose common words are most of the text's, ties to the first listed; empty without ten letters or a common word.

    Texts of which a fifth of the letters are logograms are Japanese with kana among them, else Chinese:
    they need no ten letters, as one stands for a syllable or a word.
    """
    lists = STOP_WORDS | MORE_STOP_WORDS
    common = F.filter(words(text), lambda w: w.isin(sorted({w for own in lists.values() for w in own})))

    def most(found: Column) -> Column:
        hits = [F.struct(F.size(F.filter(found, lambda w: w.isin(own))).alias("n"), F.lit(-k).alias("order"), F.lit(lang).alias("lang")) for k, (lang, own) in enumerate(lists.items())]
        best = F.greatest(*hits)
        return F.when(best["n"] > 0, best["lang"]).otherwise("")

    letters, logograms = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(_LOGOGRAM))
    asian = (logograms > 0) & (logograms * 5 >= letters)
    latin = F.element_at(F.transform(F.array(common), most), 1)
    return F.when(asian, F.when(text.rlike(_KANA), "ja").otherwise("zh")).when(letters >= 10, latin).otherwise("")


def _plain_title(title: Column) -> Column:
    """Lower case without tags, entities and ASCII punctuation; PART_WORD stands where parts meet."""
    bare = F.regexp_replace(F.regexp_replace(title, r"<[^<]*>", ""), r"(?i)&#?[a-z0-9]*", "")
    parted = F.regexp_replace(F.lower(bare), PART_MARKS, PART_WORD)
    return F.left(F.regexp_replace(F.regexp_replace(parted, r"\p{Punct}", ""), r"\s+", " "), F.lit(TITLE_CHARS))


def normalized_title(title: Column, medium: Column) -> Column:
    """The longest part of a title, if it has TITLE_PART characters and is not the medium's name; else the title."""
    plain, name = _plain_title(title), _plain_title(medium)
    parts = F.split(plain, f" *{PART_WORD} *")
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("at"), p.alias("p"))))["p"]
    return F.when((longest == plain) | (F.length(longest) < TITLE_PART) | (name == longest), plain).otherwise(longest)


def title_hash(title: Column, medium: Column) -> Column:
    return F.md5(normalized_title(title, medium))


def half_md5(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def feed_checksum(urls: Column) -> Column:
    """md5 of a feed's URLs joined by a bar: equal where nothing is new."""
    return F.md5(F.array_join(urls, "|"))
