"""Garbled text from wrong character encodings: candidate decodings judged by description length.

A chain says how a passage was read wrongly: its characters are written in the charset that was assumed, and the
bytes are decoded in the charset that was meant; a chain of several steps undoes several such readings.  Every
chain whose strict decoding gives words of one known language is a candidate for the passage.  The line with the
passage as it is and with each candidate is compressed with a zstandard dictionary of each language; the
shortest description, the cost of its chain included, wins, and the text stays as it is where none is shorter.

The dictionaries and word lists are fitted on all labelled texts, whose words and lines are counted by Spark: a word is
listed by its share of the language's texts, a dictionary holds the most frequent lines.  All documents are then examined whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histrank.session import materialize

#: Texts of a language that must hold a word for it to be listed, and their share where the language has many.
LEAST_TEXTS, LEAST_SHARE = 3, 0.006
#: Share of the texts that must hold a word of one letter.
SINGLE_SHARE = 0.05
#: Bytes of each language's dictionary.
DICTIONARY_BYTES = 48 * 1024
#: Bytes that each step of a chain costs.
STEP_COST = 0.5
#: Bytes that a chain costs whose words the lists don't know.
UNLISTED_COST = 3.0
#: Characters of the (restored) line before a line that are compressed with it.
CONTEXT = 200
#: Level of compression.
LEVEL = 12
#: Chunks of text whose candidates a worker remembers before it starts anew, and counts that it holds before it hands them on.
CACHE_CHUNKS = 200_000

# Letters of each language beside a-z.
LETTERS = {
    "en": "éï", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "pt": "àáâãçéêíóôõúü", "pl": "ąćęłńóśźż",
    "cs": "áčďéěíňóřšťúůýž", "tr": "çğıöşüâîû", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "el": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ",
}
# Charsets that may have been assumed, and that may have been meant.
ASSUMED = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "mac-roman", "cp437", "cp850", "cp932", "euc-jp")
MEANT = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "mac-roman", "cp437", "cp850", "cp932", "euc-jp")
SEVERAL_BYTES = ("utf-8", "cp932", "euc-jp")

# Signs that may touch a word on one side, and signs that may stand between letters.
BESIDE = "–—‘’“”„«»‹›…¡¿、。！？「」（）：・"
BETWEEN = "’·-–—…"
# Signs of formulas, and signs that a decoding may bring back next to plain words.
MATHS = "√≈≤≥≠−⁻±×÷⁺"
BROUGHT_BACK = "–—‘’“”„…·©«»•°€"
# Signs that are usual on their own.
USUAL = "·•©®™°±²³¹½¼¾§€£¥¢×÷№✓→←↑↓"
# Lines that trees and tables are drawn with.
TREE = "│├└─┌┐┘┤┬┴┼═║"
# Punctuation of Japanese.
JAPANESE_SIGNS = "、。！？「」『』（）：・ー〜　％＆"

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + BESIDE

PARTS = re.compile(f"[{re.escape(BETWEEN)}']")
CHUNK = re.compile(r"[^ \n\t\r]*[^\x00-\x7f \n\t\r][^ \n\t\r]*")
WORD = re.compile(r"[^\W\d_]+")
PASSAGE = re.compile(rb"[^<>\s]*[\x80-\xff][^<>\s]*")
C1 = re.compile("[\x80-\x84\x86-\x9f]")


def _table(charset: str) -> dict[int, int] | None:
    """Code point -> byte for a charset of one byte; bytes that it leaves open stand for themselves."""
    if charset in SEVERAL_BYTES:
        return None
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


_TABLES = {c: _table(c) for c in ASSUMED}
_BYTES = {c: {b: chr(u) for u, b in t.items()} for c in MEANT if (t := _table(c))}
_OUT = {c: "".join(m.get(b, chr(b)) for b in range(256)) for c, m in _BYTES.items()}


def write_as(text: str, charset: str) -> bytes | None:
    """The bytes of text in the charset, or None if it hasn't all its characters."""
    table = _TABLES[charset]
    try:
        if table is None:
            return text.encode(charset)
        return bytes([table[ord(c)] for c in text])
    except (UnicodeEncodeError, KeyError):
        return None


def read_as(data: bytes, charset: str) -> str | None:
    """data decoded strictly, or None."""
    try:
        return data.decode(charset) if charset in SEVERAL_BYTES else data.decode("latin-1").translate(_OUT[charset])
    except UnicodeDecodeError:
        return None


Chain = tuple[tuple[str, str], ...]
#: Stands for the chain of a line that is garbled while no reading is clearly the shortest.
UNCLEAR: Chain = (("unclear", "unclear"),)


def undo(text: str, chain: Chain) -> str | None:
    """text with the steps (assumed, meant) of the chain undone, or None if it can't be."""
    for assumed, meant in chain:
        data = write_as(text, assumed)
        text = None if data is None else read_as(data, meant)
        if text is None:
            return None
    return text


@dataclass
class Languages:
    """Word lists, characters and dictionaries of each language."""

    words: dict[str, frozenset[str]]
    japanese: frozenset[str]
    dictionaries: dict[str, bytes]


def language(label: str | None) -> str | None:
    """The two-letter language of a label, however it is written."""
    return label.strip().lower()[:2] if label and len(label.strip()) >= 2 else None


def lower(word: str) -> str:
    """word in lower case; the Turkish dotted capital becomes one letter."""
    return word.replace("İ", "i").lower()


def _spelled(word: str, lang: str) -> bool:
    return all(c.isascii() or c in LETTERS[lang] for c in word)


def _shaped(text: str) -> bool:
    """Whether each word is in lower case, in capitals, or begins with its only capital."""
    return all(w.islower() or w.isupper() or w[1:].islower() or not w[1:] or not w.lower() != w.upper() for w in WORD.findall(text))


def _mixed(text: str) -> bool:
    """Whether a word has letters of ASCII as well as Cyrillic, Greek or Japanese ones."""
    return any(any(c.isascii() for c in w) and any(c > "\u036f" for c in w) for w in WORD.findall(text))


def _japanese(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "一" <= c <= "鿿"


def _misread(word: str, n: int, counts: Counter) -> bool:
    """Whether another reading of the word, in charsets of the same letters, is far more frequent."""
    for form in (word, word.upper()):
        for assumed in ASSUMED:
            if (data := write_as(form, assumed)) is not None and not data.isascii():
                for meant in MEANT[1:]:
                    again = read_as(data, meant) if meant != assumed else None
                    if again and counts[lower(again)] > 4 * n:
                        return True
    return False


#: A word, line or character of a language (l) and the number of texts that hold it; the empty word stands for the texts themselves.
COUNTS = "l string, part string, n bigint"


def _counted(batches: Iterator[pa.RecordBatch], parts: Callable[[str, str], Iterable[str]]) -> Iterator[pa.RecordBatch]:
    """COUNTS of the parts of each (l, t), in pieces that are to be added up."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(counts)
        out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(out, names=["l", "part", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.update([(lang, x) for x in parts(lang, text if text.isascii() else unicodedata.normalize("NFC", text))])
            if len(counts) > CACHE_CHUNKS:
                yield rows()
                counts.clear()
    yield rows()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of words whose letters the language has, of characters of Japanese texts, and of texts."""
    spelled: dict[tuple[str, str], tuple[str, ...]] = {}

    def words(lang: str, text: str) -> set[str]:
        if lang not in LETTERS:
            return {"", *(c for c in set(text) if _japanese(c))}
        out = {""}
        for chunk in set(text.split()):
            found = spelled.get((lang, chunk))
            if found is None:
                if len(spelled) > CACHE_CHUNKS:
                    spelled.clear()
                found = spelled[lang, chunk] = tuple(x for w in PARTS.split(chunk.strip(EDGES)) if w.isalpha() and _spelled(x := lower(w), lang))
            out.update(found)
        return out

    return _counted(batches, words)


def _first_bytes(counts: DataFrame) -> dict[str, list[str]]:
    """The most frequent parts of each language in order, up to the first that DICTIONARY_BYTES don't hold."""

    def first(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("n"), "part").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.sum(F.octet_length("part") + 1).over(w)).where(F.coalesce("before", F.lit(0)) <= DICTIONARY_BYTES)

    rows = counts.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(64))).repartition("l", "salt").groupBy("l", "salt", "part").agg(F.sum("n").alias("n"))
    out: dict[str, list[str]] = defaultdict(list)
    for r in first(first(rows, "l", "salt"), "l").orderBy("l", F.desc("n"), "part").select("l", "part").collect():  # DICTIONARY_BYTES and a part for each language
        out[r["l"]].append(r["part"])
    return out


def fit_languages(rows: DataFrame) -> Languages:
    """Languages from all rows (l, t): words whose letters the language has, in at least LEAST_TEXTS texts and LEAST_SHARE of them."""
    counts = materialize(rows.mapInArrow(_count_words, COUNTS).groupBy("l", "part").agg(F.sum("n").alias("n")), "words")
    texts = {r["l"]: r["n"] for r in counts.where("part = ''").collect()}  # a number for each language
    if not texts:
        return Languages({}, frozenset(JAPANESE_SIGNS), {})
    least = {lang: max(LEAST_TEXTS, LEAST_SHARE * n) for lang, n in texts.items()}
    enough = F.col("n") >= F.create_map(*[F.lit(x) for lang, n in least.items() for x in (lang, float(n))])[F.col("l")]
    seen: dict[str, Counter] = {lang: Counter() for lang in texts}
    for r in counts.where(enough & (F.col("part") != "")).collect():  # bounded by the share: at most words of a mean text / LEAST_SHARE
        seen[r["l"]][r["part"]] = r["n"]
    words = {lang: frozenset(w for w, n in c.items() if n >= SINGLE_SHARE * texts[lang] * (len(w) == 1) and not w.isascii() and not _misread(w, n, c)) for lang, c in seen.items() if lang in LETTERS}
    japanese = frozenset(seen.get("ja", ())) | frozenset(JAPANESE_SIGNS)
    usual = {chr(c) for c in range(128)} | set(BESIDE + USUAL) | japanese
    own = {lang: usual | {c for c in map(chr, range(128, 0x3000)) if c.lower() in LETTERS.get(lang, "")} for lang in texts}

    def count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def good(lang: str, text: str) -> set[str]:
            return {x for x in text.split("\n") if len(x) < DICTIONARY_BYTES and (x.isascii() or own[lang].issuperset(x))}  # a longer one can't be held

        return _counted(batches, good)

    lines = _first_bytes(rows.mapInArrow(count_lines, COUNTS))
    short = [lang for lang in texts if lang in LETTERS and sum(len(x.encode()) + 1 for x in lines.get(lang, ())) <= DICTIONARY_BYTES]
    common: dict[str, list[str]] = {}
    if short:  # words follow the lines where these leave room
        odd = [f"{lang} {w}" for lang in short for w in seen[lang] if not w.isascii() and w not in words[lang]]
        fine = F.col("part").rlike(r"^[\x00-\x7f]+$") | (enough & ~F.concat_ws(" ", "l", "part").isin(odd))
        common = _first_bytes(counts.where(F.col("l").isin(short) & fine))
    dictionaries = {}
    for lang in texts:
        body, size = [], 0
        for part in [*lines.get(lang, ()), *common.get(lang, ())]:
            size += len(part.encode()) + 1
            if size > DICTIONARY_BYTES:
                break
            body.append(part)
        dictionaries[lang] = "\n".join(reversed(body)).encode()  # what is near the end is cheaper to point at
    return Languages(words, japanese, {k: v for k, v in dictionaries.items() if len(v) > 64})


class Judge:
    """Finds and undoes garbled passages; one per worker process."""

    def __init__(self, languages: Languages):
        import zstandard as z

        self.languages = languages
        self.known = frozenset().union(*languages.words.values()) if languages.words else frozenset()
        self.compressors = {}
        for lang, data in sorted(languages.dictionaries.items()):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors[lang] = z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.tried: dict[tuple[str, Chain], str | None] = {}
        self.cache: dict[str, dict[Chain, tuple[str, bool]] | None] = {}

    def length(self, text: str) -> int:
        """Bytes of the shortest description of text over all languages."""
        data = text.encode("utf-8", "surrogatepass")
        return min((len(c.compress(data)) for c in self.compressors.values()), default=len(data))

    def _signs_fine(self, text: str) -> bool:
        """Whether signs beyond ASCII stand where they usually do: alone, or such as BESIDE next to a word."""
        letters = [c.isalpha() and c not in "ªº" for c in text]
        alone = not any(letters)
        for i, c in enumerate(text):
            if c.isascii() or letters[i]:
                continue
            if C1.match(c) or c == "�":
                return False
            left, right = i > 0 and letters[i - 1], i + 1 < len(text) and letters[i + 1]
            kind = unicodedata.category(c)
            if c in MATHS and alone and (text == c != "√" or any(x.isdigit() for x in text)):
                continue
            if kind in ("Cf", "Mn", "Zs") or c in self.languages.japanese:
                continue
            if left and right:
                if c not in BETWEEN:
                    return False
            elif left or right:
                if c not in BESIDE and not (c == "°" and right) and not (c in "²³" and left and text[i - 1] == "m" and (i < 3 or text[:i].isascii())):
                    return False
            elif not (c in BESIDE or c in USUAL or alone and (c in TREE and (text in TREE or "─" in text) or c > "\u2600")):
                return False
        return True

    def _known(self, text: str) -> int:
        """Letters beyond ASCII in known words; -1 if something isn't known."""
        text, n = unicodedata.normalize("NFC", text), 0
        if not self._signs_fine(text):
            return -1
        for word in WORD.findall(text):
            if word.isascii():
                continue
            bare = word.rstrip("²³") if word[:-1].isascii() else word
            if lower(bare) in self.known or all(c in self.languages.japanese or c.isascii() for c in bare):
                n += sum(not c.isascii() for c in bare)
            elif any(c.isalpha() for c in bare) and not bare.isascii():
                return -1
        return n

    def _plausible(self, text: str) -> bool:
        """Whether each word is spelled with the letters of one language and the signs stand where they usually do."""
        text = unicodedata.normalize("NFC", text)
        if not self._signs_fine(text):
            return False
        for word in WORD.findall(text):
            bare = word.rstrip("²³")
            if not bare.isascii() and not any(_spelled(lower(bare), x) for x in LETTERS) and not all(c.isascii() or _japanese(c) for c in bare):
                return False
        return True

    def candidates(self, chunk: str) -> dict[Chain, tuple[str, bool]] | None:
        """Chains with (what they turn chunk into, whether the word lists know it); None if the chunk is fine as it is.

        Chains are as long as they decode: each step through UTF-8 makes the text shorter, and one through a charset of one
        byte may come last.
        """
        if chunk in self.cache:
            return self.cache[chunk]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        out: dict[Chain, tuple[str, bool]] | None = None
        if self._known(chunk) < 0:
            out = {}
            strange = not self._plausible(chunk)
            odd = strange or not _shaped(chunk) or _mixed(chunk)
            front: list[tuple[Chain, str]] = [((), chunk)]
            while front:
                after = []
                for chain, text in front:
                    for assumed in ASSUMED:
                        data = write_as(text, assumed)
                        if data is None or data.isascii():
                            continue
                        again = read_as(data, "utf-8")
                        if again is not None and again != text:
                            step = (*chain, (assumed, "utf-8"))
                            if again.isascii() or self._plausible(again):
                                out[step] = again, True
                            else:
                                after.append((step, again))
                        for meant in MEANT[1:]:
                            if meant == assumed or (again := read_as(data, meant)) is None or again == text:
                                continue
                            if (n := self._known(again)) > 0 or strange and n == 0 and not again.isascii() and all(c.isascii() or c in BROUGHT_BACK for c in again):
                                out[*chain, (assumed, meant)] = again, True
                            elif odd and not chain and n < 0 and _shaped(again) and not _mixed(again) and self._plausible(again):
                                out[*chain, (assumed, meant)] = again, False
                front = list({text: (chain, text) for chain, text in reversed(after)}.values())  # one chain for each text, the shortest
        self.cache[chunk] = out
        return out

    def _undone(self, chunk: str, chain: Chain) -> str | None:
        """chunk with the chain undone, if that is plausible."""
        if (chunk, chain) not in self.tried:
            if len(self.tried) > CACHE_CHUNKS:
                self.tried.clear()
            again = undo(chunk, chain)
            self.tried[chunk, chain] = again if again is not None and self._plausible(again) else None
        return self.tried[chunk, chain]

    def line(self, line: str, before: str = "") -> tuple[str, Chain]:
        """(line with its garbled passages restored, the chain used); the chain is empty where the line stays as it is."""
        chunks = list(CHUNK.finditer(line))
        options = [self.candidates(m[0]) for m in chunks]
        found = [c for c in options if c]
        if not found:
            return line, ()
        def context(x: str) -> str:
            return f"{before}\n{x}"

        votes = Counter(chain for c in found for chain in c)
        listed = {chain for c in found for chain, (_, known) in c.items() if known}
        as_is = float(self.length(context(line)))
        best, shortest, used, rival = line, as_is, (), as_is
        lengths = {line: as_is}
        for chain, _ in sorted(votes.items(), key=lambda x: (-x[1], len(x[0]))):
            out, at = [], 0
            for m, c in zip(chunks, options):
                if c is None:
                    continue
                again = c[chain][0] if chain in c else self._undone(m[0], chain)
                if again is not None:
                    out += [line[at : m.start()], again]
                    at = m.end()
            text = "".join(out) + line[at:]
            if text not in lengths:
                lengths[text] = self.length(context(text))
            cost = lengths[text] + STEP_COST * len(chain) + UNLISTED_COST * (chain not in listed)
            if cost < shortest:
                rival = shortest if used else rival
                best, shortest, used = text, cost, chain
            elif text != best:
                rival = min(rival, cost)
        if used and used not in listed and rival - shortest < UNLISTED_COST and rival < as_is:
            return line, UNCLEAR  # two readings are about as short: which was meant can't be told
        return best, used

    def restore(self, text: str, page: bytes | None = None) -> tuple[str, list[str]]:
        """(text with garbled lines restored, names of the chains used).

        Where lines alone are too short to tell, the page's bytes do: a passage that they don't hold as it stands, while
        they hold one of its candidates, was decoded in another charset than the page's.
        """
        if text.isascii():
            return text, []
        lines, used = text.split("\n"), []
        doubtful: list[int] = []
        for i, x in enumerate(lines):
            if x.isascii():
                continue
            again, chain = self.line(x, lines[i - 1][-CONTEXT:] if i else "")
            if chain is UNCLEAR:
                used.append("unclear")
            elif chain and again != x:
                lines[i] = again
                used.append(">".join(f"{a}:{m}" for a, m in chain))
            elif page and any(self.candidates(m[0]) for m in CHUNK.finditer(x)):
                doubtful.append(i)
        if doubtful and (whole := self.page_text(page)) is not None:
            for i in doubtful:
                for m in CHUNK.finditer(lines[i]):
                    if m[0] in whole:
                        continue
                    for chain, (again, _) in (self.candidates(m[0]) or {}).items():
                        if again in whole:
                            lines[i] = lines[i].replace(m[0], again)
                            used.append(">".join(f"{a}:{b}" for a, b in chain))
                            break
        return "\n".join(lines), sorted(set(used))

    def page_text(self, page: bytes) -> str | None:
        """The page read in the charset in which its passages beyond ASCII are shortest to describe; UTF-8 wins where it decodes."""
        parts = [p for p in PASSAGE.findall(page)]
        if not parts:
            return None
        joined = b" ".join(parts)
        sizes = {m: self.length(again) for m in MEANT if (again := read_as(joined, m)) is not None}
        if "utf-8" not in sizes and not sizes:
            return None
        return html.unescape(read_as(page, "utf-8" if "utf-8" in sizes else min(sizes, key=sizes.get)) or "") or None

    def from_page(self, text: str, page: bytes | None) -> str | None:
        """text with the lines that lost characters (U+FFFD) replaced by the page's own, read in the charset of least length."""
        if not page:
            return None
        parts = [p for p in re.split(rb"<[^>]*>|[\r\n]+", page) if p.strip()]
        sizes = {m: sum(self.length(x) for x in again) for m in MEANT if None not in (again := [read_as(p, m) for p in parts if not p.isascii()])}
        if not sizes:
            return None
        meant = min(sizes, key=sizes.get)
        right = {html.unescape(p.decode("utf-8", "replace")).strip(): html.unescape(read_as(p, meant)).strip() for p in parts if not p.isascii()}
        return "\n".join(right.get(x.strip(), x) if "�" in x else x for x in text.split("\n"))


def labelled_texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(l, t): all texts that aren't empty, with the language of their label, if it has letters here or is Japanese."""
    rows = df.select(F.lower(F.substring(F.trim(F.col(lang)), 1, 2)).alias("l"), F.col(text).alias("t"))
    return rows.where(F.col("l").isin(*LETTERS, "ja") & (F.length("t") > 0))


def sample_texts(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """The former name of labelled_texts, from when fits took a sample by the hash of the key."""
    return labelled_texts(df, text, lang)


def find_garbled(df: DataFrame, key: str, text: str, lang: str, page: str | None = None, restore: bool = True) -> DataFrame:
    """(key, chains, restored): the records whose text has a passage that was decoded in another charset than it was written in.

    A text that has U+FFFD lost characters in decoding; it is restored from the page's bytes where they are given,
    else `restored` is null.  Null and empty texts are never found.  With restore=False only the key is filled.
    """
    session = df.sparkSession.sparkContext
    shared = session.broadcast(fit_languages(labelled_texts(df, text, lang)))  # bounded: words by their share of texts, dictionaries of fixed size
    picked = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(key, text, *([page] if page else []))
    schema = T.StructType([picked.schema[0], T.StructField("chains", T.ArrayType(T.StringType())), T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        judge = languages.judge = getattr(languages, "judge", None) or Judge(languages)  # one per worker process
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            pages = b.column(2) if b.num_columns > 2 else None
            at, chains, restored = [], [], []
            for i, t in enumerate(texts):
                raw = pages[i].as_py() if pages is not None else None
                again, used = judge.restore(t, raw)
                if "�" in t:
                    used = [*used, "lost"]
                    again = judge.from_page(again, raw) if restore and raw else None
                if used:
                    at.append(i)
                    chains.append(used)
                    restored.append(again if restore else None)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(chains, pa.list_(pa.string())), pa.array(restored, pa.string())], names=[key, "chains", "restored"])

    return picked.mapInArrow(run, schema)
