"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

One pass lists the distinct entities.  A person's name is a given name and a family name, each an entity of its
own, so that full and short mentions of a person agree; a name that stands alone is found where the same text has it in full.
Each entity gets a surrogate from a keyed hash; of entities that would share one all but the first draw again, and so does
one whose surrogate is some entity of the corpus itself.  All names of a script are one space of names.
A second pass rewrites the texts.  It draws the same surrogates, and only needs to be told of the few
entities whose first draw did not hold.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import as_text, cut, slices, through_arrow

# Given names by script and gender (n: either), family names by script (a final # takes the gender's ending), what further names are made
# of (beginnings, then endings), titles by gender (n: says nothing of it), particles of family names, and words of streets.
GIVEN = {
    ("latin", "f"): "Alice Amy Andrea Anna Barbara Beatrice Carla Caroline Charlotte Clara Diana Elena Elizabeth Emily Emma Eva Fiona Grace Hannah Helen Ingrid Irene Isabel Jane Jennifer Jessica Julia Karin Kate Laura Linda Lisa Lucia Lucy Margaret Maria Marie Martha Mary Monica Natalie Nina Nora Olivia Patricia Paula Rosa Ruth Sandra Sarah Sophia Sophie Susan Teresa Ursula Vera Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Arthur Benjamin Brian Carlos Charles Christopher Daniel David Edward Eric Felix Francis Frank Fred George Gustav Henry Hugo Ivan Jack Jacob James John Joseph Juan Karl Kevin Leo Lucas Luis Marco Mark Martin Matthew Max Michael Miguel Oliver Oscar Patrick Paul Pedro Peter Philip Richard Robert Samuel Simon Stefan Steven Thomas Victor Walter William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Нина Ольга Полина Светлана София Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Максим Михаил Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος".split(),
}
NEUTRAL = {"latin": "Alex Charlie Jamie Jordan Kim Robin Sam Toni".split(), "cyrillic": "Женя Саша Валя Паша".split(), "greek": "Χρυσ Φοίβη Άρι Ίων".split()}
FAMILY = {
    "latin": "Abbott Baker Becker Bennett Blanc Carter Castro Cooper Dubois Ellis Fischer Foster Garcia Gomez Hansen Harris Hofmann Keller Lambert Larsen Lopez Marsh Mercier Meyer Miller Moreau Morgan Navarro Olsen Parker Reyes Richter Roux Schmidt Sutter Taylor Torres Vogel Weber Wright".split(),
    "cyrillic": "Белов# Волков# Егоров# Иванов# Козлов# Лебедев# Морозов# Новиков# Орлов# Петров# Соколов# Фёдоров#".split(),
    "greek": "Αλεξίου Γεωργίου Δημητρίου Ιωάννου Νικολάου Παύλου Στεφάνου Χρήστου".split(),
}
MADE = {
    ("latin", "f"): ("Adel Am Arn Bel Cal Cor Dal El Fel Gal Hel Ir Jos Kar Lor Mar Ner Ros Sel Val".split(), "a ana ella ena etta ina isa ola ora une".split()),
    ("latin", "m"): ("Al Bern Cor Dag El Ferd Ger Har Is Jor Kon Leon Mar Nor Os Rein Sev Theod Ul Wal".split(), "ald ard en hart ic ien in mund on us".split()),
    ("latin", "n"): ("Bri Cam Dar Em Har Kel Lin Mor Qui Ry".split(), "an ary en ey is in ley on".split()),
    ("latin", "family"): ("Ash Bar Black Brad Brook Carl Clay Cran Dal Ed Fair Fen Gar Hal Har Hol Kel Kirk Lan Lock Mar Mel Nor Oak Pem Rad Ren Sel Shel Stan Thorn Wal War West Whit".split(), "berg born bridge brook bury by croft dale den field ford ham hurst land ley man more ridge ster ston ton ville ward well wick wood worth".split()),
    ("cyrillic", "f"): ("Ал Вал Дар Ев Зин Кам Лар Мар Рим Сер".split(), "ия ина ея ана ата".split()),
    ("cyrillic", "m"): ("Ад Бор Гер Дам Ев Клим Мир Род Сев Яр".split(), "ан ий ин он ослав".split()),
    ("cyrillic", "n"): ("Бор Вал Гал Жен Мит Сан Сим Шур".split(), "я ка ша".split()),
    ("cyrillic", "family"): ("Бар Вер Гор Дуб Жар Зим Кал Лес Мел Нов Пол Руд Сел Тар Яс".split(), "ин# ков# ников# цев# нов# ев#".split()),
    ("greek", "f"): ("Αγλα Δαν Ευ Θε Καλ Λυδ Ξεν".split(), "ία άη ώνη ίνα".split()),
    ("greek", "m"): ("Αρ Δαμ Ευ Θε Λε Μεν Φιλ".split(), "ανός έας ίων όδωρος".split()),
    ("greek", "n"): ("Αρ Δαμ Λυ Φιλ".split(), "ις ώ ι".split()),
    ("greek", "family"): ("Ανδρ Βασιλ Κων Λαμπρ Μαυρ Παπ Σαρ Τσικ".split(), "άκης όπουλος ίδης έλης ιάδης".split()),
}
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mister": "m", "Sir": "m", "Lady": "f", "Lord": "m", "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f",
    "Don": "m", "Doña": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Dr": "n", "Prof": "n", "Professor": "n", "Doctor": "n", "Rev": "n", "Capt": "n", "Captain": "n", "Judge": "n", "Senator": "n",
    "господин": "m", "госпожа": "f", "кύριος": "m", "κυρία": "f",
}
PARTICLES = "van von der den de la del di da dos le du zu al bin ibn".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Square Sq Place Pl Terrace Crescent".split()
FEMININE = re.compile(r"(?<=ов|ев|ёв|ин|ын)а$")

_gender = {(s, n): g for (s, g), names in GIVEN.items() for n in names}
_upper = r"[A-ZÀ-ÖØ-ÞĀ-ŽΆ-ΫЀ-Я]"
_word = rf"{_upper}(?:\w|['’](?!s(?!\w))(?=\w)|-(?=\w))+"
_longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
_family = rf"(?:(?:{_longest(PARTICLES)}) ){{0,3}}{_word}"
_initials = r"(?P<i>(?: [A-ZА-Я]\.){0,3})"
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_hex = r"[0-9A-Fa-f]{1,4}"
PATTERNS = [
    ("email", r"(?P<email>(?<![\w.+'-])[A-Za-z0-9][\w.+'-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-]))"),
    ("key", r"(?P<key>(?<![\w-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,128}|xox[abpr]-[A-Za-z0-9-]{10,128}|AIza[\w-]{35})(?![\w-]))"),
    ("secret", r"(?P<secret>(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api_?key|access_?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?P<value>[A-Za-z0-9_+/=.-]{6,256}))"),
    ("ipv6", rf"(?P<ipv6>(?<![\w:.])(?:(?:{_hex}:){{7}}{_hex}|(?:{_hex}:){{1,6}}(?::{_hex}){{1,6}})(?![\w:]))"),
    ("ip", rf"(?P<ip>(?<![\w.]){_octet}(?:\.{_octet}){{3}}(?![\w]|\.\d))"),
    ("iban", r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"),
    ("ssn", r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"),
    ("card", r"(?P<card>(?<![\w-])(?:[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-]))"),
    ("phone", r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,+-])(?<!\d )(?:\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\w-]|[.,]\d| \d))"),
    ("street", rf"(?P<street>(?<![\w.,-])\d{{1,5}} (?:{_upper}[\w'’-]+ ){{1,3}}(?:{_longest(STREETS)})(?!\w)|(?<!\w){_upper}\w{{2,30}}(?:straße|strasse|weg|platz|gasse|allee) \d{{1,4}}[a-z]?(?!\w))"),
]
NUMERIC = re.compile("|".join(p for _, p in PATTERNS))
TITLED = re.compile(rf"(?<!\w)(?P<t>{_longest(TITLES)})\.? (?:(?P<a>{_word}){_initials} (?P<b>{_family})|(?P<c>{_family}))")
NAMED = re.compile(rf"(?<!\w)(?P<a>(?:{_longest({n for _, n in _gender})})(?:-{_upper}\w+)?){_initials} (?P<b>{_family})")
_hint = re.compile("[0-9@]")
_any_hint = re.compile("[0-9@]|AKIA|ASIA|AIza|(?i:passw|pwd|secret|token|key|xox|sk-|gh[pousr]_)")
_key_hints = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_secret_hints = ("passw", "pwd", "secret", "token", "key", "xox", "sk-")
_token = re.compile(r"\w+")
_name_hints = frozenset(TITLES) | {n for _, n in _gender}


def script_of(text: str) -> str:
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _names(text: str, m: re.Match, title: str | None) -> list[tuple[int, int, str, str]]:
    """The entities of a match of TITLED or NAMED: given name, initials and family name, as far as they are there."""
    group = m.groupdict()
    a, b = ("a", "b") if group["a"] else (None, "c")
    out = []
    script = script_of(m[a or b])
    gender = TITLES[title] if title else "n"
    if a:
        gender = _gender.get((script, m[a].split("-")[0]), gender)
        out.append((*m.span(a), f"given-{gender}-{script}", m[a]))
        start = m.start("i")
        out += [(start + 3 * k + 1, start + 3 * k + 2, "initial", m["i"][3 * k + 1]) for k in range(len(m["i"]) // 3)]
    family = m[b]
    if script == "cyrillic" and FEMININE.search(family):
        gender, family = "f", family[:-1]
    out.append((*m.span(b), f"family-{script}", family))
    return out


def _hinted(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the lines that can hold numbers, addresses or secrets; none of these goes over a line's end."""
    at = 0
    while m := _any_hint.search(text, at):
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield text.rfind("\n", 0, m.start()) + 1, end
        at = end


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical), in order and without overlaps.  Other writings of an entity share its canonical form."""
    found: list[tuple[int, int, str, str]] = []
    low = text.lower()
    if _hint.search(text) or any(x in low for x in _secret_hints) or any(x in text for x in _key_hints):
        for m in (m for a, b in _hinted(text) for m in NUMERIC.finditer(text, a, b)):
            kind = next(k for k, _ in PATTERNS if m.group(k) is not None)
            a, b = m.span("value" if kind == "secret" else kind)
            raw = text[a:b]
            if kind in ("email", "ipv6"):
                canonical = raw.lower()
                if kind == "ipv6" and (len(re.findall("[0-9a-f]+", canonical)) < 3 or not any(c.isdigit() for c in canonical)):
                    continue
            elif kind in ("ip", "secret", "key", "street"):
                canonical = raw
            else:
                canonical = "".join(c for c in raw if c.isalnum())
                if kind == "phone" and not 7 <= len(canonical) <= 15 or kind == "card" and not 13 <= len(canonical) <= 19:
                    continue
            found.append((a, b, kind, canonical))
    if not _name_hints.isdisjoint(_token.findall(text)):  # names stand between characters that are no part of words, as tokens do
        names: list[tuple[int, int, str, str]] = []
        for m in TITLED.finditer(text):
            names += _names(text, m, m["t"])
        for m in NAMED.finditer(text):
            if m["b"].split("'")[0] not in _name_hints:
                names += _names(text, m, None)
        # The same person by one name alone: what the text calls a given or family name is one wherever it stands.
        alone = {}
        for a, b, kind, canonical in names:
            if kind != "initial":
                known = alone.get(text[a:b])
                if known is None or (known[0].startswith("given-n") and kind.startswith("given")):
                    alone[text[a:b]] = (kind, canonical)
        found += [(a, b, *alone[text[a:b]]) if kind.startswith("given") and alone[text[a:b]][0].startswith("given") else (a, b, kind, canonical) for a, b, kind, canonical in names]
        if alone:
            found += [(*m.span(), *alone[m[0]]) for m in re.finditer(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(alone, key=len, reverse=True)))})(?![\w-])", text)]
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def space_of(kind: str) -> str:
    """Surrogates are distinct within a space: all names of a script, or a kind."""
    return f"name-{kind.rsplit('-', 1)[1]}" if kind.startswith(("given-", "family-")) else kind


class Draw:
    """A stream of numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.seed, self.block, self.pool = key, "\x1f".join(parts).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 40:
            self.pool = int.from_bytes(hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.block += 1
        self.pool, x = divmod(self.pool, n)
        return x

    def one(self, words: list[str]) -> str:
        return words[self.below(len(words))]

    def like(self, text: str, hexa: bool = False) -> str:
        """Digits for digits and letters for letters of the same case; other characters stay."""
        low = "abcdef" if hexa else "abcdefghijklmnopqrstuvwxyz"
        return "".join(chr(48 + self.below(10)) if c.isdigit() else low[self.below(len(low))] if c.islower() else low[self.below(len(low))].upper() if c.isupper() else c for c in text)


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    """1 for an IBAN with the right check digits."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form that replaces an entity, as draw number ``attempt`` has it."""
    d = Draw(key, kind, canonical, str(attempt))
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        name = labels[0] if len(labels) > 1 else "mail"
        host = Draw(key, "domain", domain).like(name)  # addresses of one domain keep one domain
        reserved = labels[-1] if labels[-1] in ("com", "net", "org") else "com"
        return f"{d.like(local)}@{host}.example.{reserved}"
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        return ".".join(str(a + d.below(b - a + 1)) for a, b in (ranges[len(x)] for x in canonical.split(".")))
    if kind == "ipv6":
        return "".join("0123456789abcdef"[d.below(16)] if c.isalnum() else c for c in canonical)
    if kind == "secret":
        return d.like(canonical, hexa=bool(re.fullmatch(r"[0-9a-fA-F]+", canonical)))
    if kind == "key":  # what names its kind stays
        head = 4 if canonical[3] != "-" else 3
        return canonical[:head] + d.like(canonical[head:])
    if kind == "iban":
        body = d.like(canonical[4:])
        right = 98 - mod97(f"{canonical[:2]}00{body}")
        wrong = (right + 1 + d.below(90)) % 97
        return f"{canonical[:2]}{right if mod97(canonical) == 1 else wrong:02d}{body}"
    if kind == "ssn":
        area = 1 + d.below(898)
        return f"{area + (area >= 666):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}"
    if kind == "card":
        body, check = canonical[0] + d.like(canonical[1:-1]), d.below(10)
        valid = luhn(canonical) == 0
        fits = next(c for c in range(10) if luhn(f"{body}{c}") == 0)
        return f"{body}{fits if valid else check if check != fits else (check + 1) % 10}"
    if kind == "phone":
        lead = len(canonical) - 10 if len(canonical) > 10 else 0  # the country code stays
        if canonical[lead] == "0":
            return canonical[: lead + 1] + d.like(canonical[lead + 1 :])
        return canonical[:lead] + str(2 + d.below(8)) + d.like(canonical[lead + 1 :])
    if kind == "street":
        words = canonical.split(" ")
        begin, end = MADE["latin", "family"]
        if words[0].isdigit():
            return " ".join([str(1 + d.below(9)) + d.like(words[0][1:]), *(d.one(begin) + d.one(end) for _ in words[2:]), words[-1]])
        stem = next(x for x in ("straße", "strasse", "weg", "platz", "gasse", "allee") if words[0].endswith(x))
        return f"{d.one(begin)}{d.one(end)}{stem} {d.like(words[1])}"
    if kind.startswith(("given-", "family-")):
        part, script = kind.split("-")[-2:]
        if part == "family":
            listed, (begin, end) = FAMILY[script], MADE[script, "family"]
        else:
            listed, (begin, end) = NEUTRAL[script] if part == "n" else GIVEN[script, part], MADE[script, part]
        if not attempt:
            return d.one(listed)
        made = lambda: d.one(begin) + d.one(end)
        return "-".join(made() for _ in range(1 + attempt.bit_length() // 3))  # single names run out; double names do not
    return d.like(canonical)


def render(original: str, kind: str, canonical: str, new: str) -> str:
    """``new`` written the way ``original`` writes ``canonical``."""
    if kind.startswith(("given-", "family-")):
        # The base of a family name takes the ending that the original has.
        text = re.sub("#(?=-|$)", "а" if kind == "family-cyrillic" and original != canonical and FEMININE.search(original) else "", new)
        return text.upper() if original.isupper() else text
    if kind in ("email", "ipv6"):
        return new.upper() if original.isupper() else new
    if kind in ("ip", "secret", "key", "street"):
        return new
    left = iter(new)
    return "".join(next(left) if c.isalnum() else c for c in original)


def entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canonical), each once; initials are none, as 26 letters cannot be distinct."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen = sorted({f[2:] for t in as_text(b.column("text")) for f in detect(t) if f[2] != "initial"})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], ["kind", "canonical"])

    return df.select(F.col(text_col).alias("text")).transform(through_arrow, run, "kind string, canonical string").distinct()


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, surrogate): distinct for distinct entities of a space (space_of), and no entity of it.

    An entity keeps the first draw that neither an entity is, nor an earlier draw of another one, nor that of a lesser one in the same round; only the others draw again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, forms, turns = (b.column(c).to_pylist() for c in ("kind", "canonical", "attempt"))
            new = [surrogate(key, *r) for r in zip(kinds, forms, turns)]
            plain = [n.replace("#", "") for n in new]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canonical"), b.column("attempt"), pa.array(new, pa.string()), pa.array([space_of(k) for k in kinds], pa.string()), pa.array(plain, pa.string())], names)

    names = ["kind", "canonical", "attempt", "surrogate", "space", "plain"]
    spaced = F.when(F.col("kind").rlike("^(given|family)-"), F.concat(F.lit("name-"), F.element_at(F.split("kind", "-"), -1))).otherwise(F.col("kind"))
    found = cut(found.withColumn("space", spaced))
    taken = found.select("space", F.col("canonical").alias("plain")).distinct()
    waiting, settled = found.select("kind", "canonical").withColumn("attempt", F.lit(0)), []
    while True:
        drawn = waiting.transform(through_arrow, run, "kind string, canonical string, attempt int, surrogate string, space string, plain string")
        place = F.row_number().over(Window.partitionBy("space", "plain").orderBy("kind", "canonical"))
        used = reduce(DataFrame.unionByName, [taken, *(x.select("space", "plain") for x in settled)]).withColumn("used", F.lit(True))
        checked = cut(drawn.withColumn("place", place).join(used.distinct(), ["space", "plain"], "left").withColumn("holds", (F.col("place") == 1) & F.col("used").isNull()))
        settled.append(checked.where("holds"))
        waiting = checked.where("NOT holds").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, settled).select("kind", "canonical", "attempt", "surrogate")


def pseudonymise(df: DataFrame, *, key: bytes, text_col: str = "text", spans_col: str | None = None, most_told: int = 200_000) -> DataFrame:
    """The rows of df, all columns as they are but for the text, whose entities are replaced.

    spans_col: name of a further column, array<struct<start,end,kind>>, with the places of the surrogates in
    the new text.  The same entity gets the same surrogate in all texts; different entities of a kind get
    different ones.  Null texts stay null; texts without entities do not change.  Up to most_told entities
    that needed another draw are sent to all workers; beyond that they are joined to the texts that hold them.
    """
    names, schema = df.columns, df.schema
    table = assign(entities(df, text_col), key)
    again = cut(table.where("attempt > 0").select("kind", "canonical", "attempt"))
    few = again.limit(most_told + 1).count() <= most_told
    shared = df.sparkSession.sparkContext.broadcast({(r["kind"], r["canonical"]): r["attempt"] for r in again.collect()} if few else {})
    if not few:
        df = _told(df, again, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = lru_cache(maxsize=20_000)(lambda kind, canonical, attempt: surrogate(key, kind, canonical, attempt))
        at = names.index(text_col)
        for b in slices(batches, at):
            told = b.column(len(names)).to_pylist() if b.num_columns > len(names) else None
            texts, spans = [], []
            for i, t in enumerate(b.column(at).to_pylist()):
                known = {(x["kind"], x["canonical"]): x["attempt"] for x in told[i] or []} if told else shared.value
                found = detect(t) if t else []
                parts, last, size, places = [], 0, 0, []
                for a, z, kind, canonical in found:
                    new = render(t[a:z], kind, canonical, draw(kind, canonical, known.get((kind, canonical), 0)))
                    parts += [t[last:a], new]
                    size += a - last
                    places.append({"start": size, "end": size + len(new), "kind": kind})
                    size, last = size + len(new), z
                texts.append("".join([*parts, t[last:]]) if found else t)
                spans.append(places)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if spans_col:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, [*names, spans_col] if spans_col else names)

    if spans_col:
        schema = StructType([*schema.fields]).add(spans_col, DataType.fromDDL("array<struct<start:int,end:int,kind:string>>"))
    return df.transform(through_arrow, run, schema)


def _told(df: DataFrame, again: DataFrame, text_col: str) -> DataFrame:
    """df with a last column of the entities of ``again`` that each text holds, by a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(h, k, c) for h, t in zip(b.column("h").to_pylist(), as_text(b.column("text"))) for k, c in {f[2:] for f in detect(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], ["h", "kind", "canonical"])

    h = F.xxhash64(text_col)
    held = df.select(h.alias("h"), F.col(text_col).alias("text")).transform(through_arrow, run, "h long, kind string, canonical string").distinct()
    name = "told"
    while name in df.columns:
        name += "_"
    lists = held.join(again, ["kind", "canonical"]).groupBy("h").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(name))
    return df.join(lists, F.xxhash64(df[f"`{text_col}`"]) == lists["h"], "left").select(*[df[f"`{c}`"] for c in df.columns], lists[name])
