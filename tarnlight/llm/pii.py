"""Keyed surrogates for personal data.

Entities are found in the whole text: mail addresses, telephone numbers
(international, and national ones of the formats of ENTITY), IP addresses, card
numbers, IBANs, social security numbers, secrets, and names of persons: up to
four parts after a title, or after a known given name. Names without either,
those in scripts without capitals among them, are not found. Each distinct
entity gets one surrogate from a keyed hash, the same wherever it is mentioned,
in whatever format: same type, same length and separators for what is made of
characters, same gender, script and case for names (a surname and its feminine
form are one entity, of two forms). Surrogates are checked
against each other and against all originals of the corpus; one that collides
is drawn again, so that distinct entities stay distinct.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.pairs import light
from tarnlight.shared import cut, spread, written

KEY = "tarnlight-demonstration-key"

GIVEN = {
    ("Latin", "m"): "James John Robert Michael William David Thomas Charles Daniel Matthew Peter Hans Klaus Jürgen Stefan Andreas Wolfgang Pierre Jacques Michel Philippe François Carlos Miguel Javier Antonio Fernando Alejandro".split(),
    ("Latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Ursula Monika Sabine Petra Brigitte Gisela Marie Isabelle Nathalie Catherine Sylvie Céline Carmen Lucía Cristina Pilar Dolores Beatriz".split(),
    ("Latin", "n"): "Robin Taylor Jordan Casey Morgan Alexis Dominique Claude Sascha Kerry Avery Quinn Rowan Skyler Jamie Riley".split(),
    ("Cyrillic", "m"): "Иван Алексей Сергей Дмитрий Николай Михаил Андрей Владимир Павел Константин".split(),
    ("Cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Людмила".split(),
    ("Cyrillic", "n"): "Саша Женя Валя Шура Слава Тоня".split(),
    ("Greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης".split(),
    ("Greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
    ("Greek", "n"): "Άρτεμις Χάρις Άλκηστις".split(),
}
#: Given names that are known besides those that are given.
MORE_GIVEN = {
    "m": "José Juan Luis Pedro Jorge Manuel Paulo João Marco Giovanni Luca Mario Mohammed Muhammad Ahmed Ali Omar Hassan Ibrahim Wei Jun Hiroshi Kenji Takashi Ivan Dmitri Sergei Alexei Piotr Paweł Lars Sven Erik George Richard Joseph Paul Mark Steven Andrew Kevin Brian Edward Henry Louis Jean Henri Étienne Markus Tobias Jörg Uwe".split(),
    "f": "Maria Ana Anna María Elena Olga Natasha Irina Giulia Chiara Francesca Fatima Aisha Leila Mei Ling Yuki Keiko Katarzyna Agnieszka Ingrid Astrid Emma Sophie Julia Laura Claudia Martina Helen Margaret Nancy Lisa Betty Sandra Ashley Emily Anne Camille Chloé Amélie Teresa Rosa Isabel Rosario".split(),
}
#: By script and form. in, adj and slav have feminine forms; Greek ones in m are a man's, in f a woman's.
SURNAMES = {
    ("Latin", "n"): "Smith Johnson Williams Brown Jones Miller Wilson Anderson Taylor Clark Walker Hall Young Wright Hill Baker Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Koch Bauer Richter Martin Bernard Dubois Moreau Laurent Lefebvre Leroy Roux Fournier Girard García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Ruiz Navarro Torres".split(),
    ("Latin", "slav"): "Ivanov Petrov Sidorov Kuznetsov Popov Vasiliev Smirnov Volkov Morozov Lebedev Novikov Pavlov".split(),
    ("Cyrillic", "in"): "Иванов Петров Сидоров Кузнецов Попов Васильев Смирнов Волков Фёдоров Морозов Лебедев Новиков".split(),
    ("Cyrillic", "adj"): "Вишневский Покровский Троицкий Островский Лозинский Заболоцкий".split(),
    ("Cyrillic", "n"): "Шевченко Коваленко Бондаренко Ткаченко Мороз Коваль".split(),
    ("Greek", "m"): "Παπαδόπουλος Παππάς Νικολαΐδης Αλεξάκης Καραγιάννης Βλάχος".split(),
    ("Greek", "f"): "Παπαδοπούλου Αγγελοπούλου Νικολαΐδου Καραγιάννη Βλάχου Παππά".split(),
    ("Greek", "n"): "Γεωργίου Οικονόμου Νικολάου Ιωάννου Δημητρίου Βασιλείου".split(),
}
SYLLABLES = {"Latin": "bar den fal gor hel kin lor mar nel par ros tan ver win zor".split(), "Cyrillic": "бар вел гор дан кол лев мир нов рад сол тар".split(), "Greek": "βαρ γελ δων καλ λαμ μαν νικ παπ ρασ ταρ".split()}
#: Endings of invented surnames.
ENDINGS = {("Latin", "slav"): "ov", ("Cyrillic", "in"): "ов", ("Cyrillic", "adj"): "ский", ("Cyrillic", "n"): "енко", ("Greek", "m"): "άκης", ("Greek", "f"): "οπούλου", ("Greek", "n"): "ίου"}
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr г-н господин Κύριος κ".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra г-жа госпожа Κυρία".split(),
    "n": "Dr Prof Professor Doctor Доктор".split(),
}
GENDER_OF = {t: g for g, ts in TITLES.items() for t in ts}
GENDER_OF_GIVEN = {n.casefold(): g for g, ns in MORE_GIVEN.items() for n in ns} | {n.casefold(): g for (_, g), ns in GIVEN.items() for n in ns}
PARTICLES = "de la del los las von van der den di da du le y".split()


def trie(words: list[str]) -> str:
    """A pattern of the words that tries each character once; longer ones first."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        parts = [re.escape(c) + pattern(at[c]) for c in sorted(at) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in at else "(?:" + "|".join(parts) + ")"
        return body + "?" * ("" in at)

    return pattern(tree)


def letters(category: str) -> str:
    """A character class of the letters of a category, of the scripts that have two cases."""
    codes, ranges = [i for i in range(0x2E80) if unicodedata.category(chr(i)) == category], []
    for i in codes:
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


_u, _l = letters("Lu"), letters("Ll")
_piece = rf"(?:{_u}['’])?(?:Ma?c)?{_u}{_l}+"
_name = rf"{_piece}(?:-{_piece})*"
_part = rf"(?:{_name}|{_u}{{2,}}\b)"
_more = rf"(?:[ ](?:(?:{trie(PARTICLES)})[ ]){{0,2}}{_part})"
_titles = trie(list(GENDER_OF))
_given = trie(sorted({n for (_, g), ns in GIVEN.items() if g != "n" for n in ns} | {n for ns in MORE_GIVEN.values() for n in ns}))
_either = trie(sorted({n for (_, g), ns in GIVEN.items() if g == "n" for n in ns}))
_surnames = trie(sorted({n for ns in SURNAMES.values() for n in ns}))
_secret = r"(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)"
ENTITY = re.compile(
    rf"""
    (?P<email>[\w][\w.+%-]*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{{2,}})
  | (?i:\b{_secret}\b["']?\s*[:=]\s*["']?)(?P<secret>[^\s"',;]{{6,}})
  | (?P<key>\b(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{20,}}|sk-[0-9A-Za-z-]{{20,}})\b)
  | (?P<phone>(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}(?!\d)
      | (?<![\w(])\(\d{{3}}\)[ ]?\d{{3}}[ .-]\d{{4}}(?!\d)
      | (?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-])
      | (?<![\w.,-])0[1-9](?:[ .-]\d{{2}}){{4}}(?![\w-])
      | (?<![\w.,-])0\d{{2,4}}[ /-]\d{{3}}[ ]?\d{{3,5}}(?![\w-])
      | (?<![\w.,-])[6-9]\d{{2}}[ ](?:\d{{3}}[ ]\d{{3}}|\d{{2}}[ ]\d{{2}}[ ]\d{{2}})(?![ ]?\d)(?![\w-])
      | (?<![\w.,-])555[ -]\d{{3}}[ -]?\d{{4}}(?![\w-])
      | (?<![\w.,-])555[ -]\d{{4}}(?![\w-]))
  | (?P<ssn>(?<![\w.-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
  | (?P<ip>(?<![\w.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\.?\d)(?!\w) | (?<![\w:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:]))
  | (?P<card>(?<![\w.])\d(?:[ -]?\d){{12,18}}(?!\w))
  | \b(?P<title>{_titles})\b\.?[ ](?P<person>{_part}{_more}{{0,3}})
  | \b(?P<both>(?:{_given})\b{_more}{{1,3}}|(?:{_either})[ ](?:{_surnames}))\b
    """,
    re.X,
)
#: A text without a match of this has no entity; for the JVM.
CUE = rf"[0-9@]|(?i:{_secret})|\b(?:{_titles})\b\.? |\b(?=\p{{Lu}})(?:{_given}|{_either}) |AKIA|sk-|gh[pousr]_"
GROW = 16  # draws of one entity after which its surrogate gets longer


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script_of(word: str) -> str:
    return "Cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "Greek" if "Ͱ" <= word[0] <= "Ͽ" else "Latin"


FEMININE = {"Cyrillic": (("ская", "ский", "adj"), ("цкая", "цкий", "adj"), ("ова", "ов", "in"), ("ева", "ев", "in"), ("ёва", "ёв", "in"), ("ина", "ин", "in"), ("ына", "ын", "in")), "Latin": (("ova", "ov", "slav"), ("eva", "ev", "slav")), "Greek": ()}


def surname_of(word: str) -> tuple[str, str, bool]:
    """Form, masculine form in lower case, and whether the surname is feminine."""
    low, script = word.casefold(), script_of(word)
    for ending, other, form in FEMININE[script]:
        if low.endswith(ending):
            return form, low[: -len(ending)] + other, True
        if low.endswith(other):
            return form, low, False
    if script == "Greek":
        return "m" if low.endswith("σ") else "f" if low.endswith(("ούλου", "ίδου")) else "n", low, False
    return "n", low, False


def feminine(name: str) -> str:
    """The feminine form of a masculine surname that has one."""
    return name[:-2] + "ая" if name.endswith(("ский", "цкий")) else name + ("а" if script_of(name) == "Cyrillic" else "a")


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, cls, canonical form) of the entities of a text, in order, none overlapping.

    The canonical form is the same for all formats of an entity; cls says what
    else its surrogate must match. Names are entities by their parts, so that
    'Mr Smith' and 'John Smith' share a surname.
    """
    found = []
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        if kind == "person" or kind == "both":
            start, parts = m.start(kind), m[kind].split(" ")
            gender = GENDER_OF.get(m["title"] or "", "n")
            names = [p for p in parts if p not in PARTICLES]
            seen = 0
            for part in parts:
                end = start + len(part)
                if part not in PARTICLES:
                    known = part.casefold() in GENDER_OF_GIVEN
                    given = known and gender == "n" if len(names) == 1 else not seen or known and seen < len(names) - 1
                    seen += 1
                    if given:
                        sex = gender if gender != "n" else GENDER_OF_GIVEN.get(part.casefold(), "n")
                        found.append((start, end, "given", f"{script_of(part)} {sex}", part.casefold()))
                    else:
                        form, value, _ = surname_of(part)
                        found.append((start, end, "surname", f"{script_of(part)} {form}", value))
                start = end + 1
            continue
        value, cls = m[kind], ""
        if kind == "email":
            value = value.lower()
        elif kind == "phone":
            cls = str(len(re.match(r"\+(\d{0,3}?)(?=[ .(-]|$)", value)[1])) if re.match(r"\+\d{0,3}?[ .(-]", value) else str(int(value[0] == "0"))
            value = ("+" if value[0] == "+" else "") + digits_of(value)
        elif kind == "card":
            value = digits_of(value)
            cls = "luhn" if luhn(value) else ""
        elif kind == "ssn":
            value = digits_of(value)
        elif kind == "iban":
            value = value.replace(" ", "")
            if not 15 <= len(value) <= 34 or iban_rest(value) != 1:
                continue
        elif kind == "ip" and ":" not in value:
            if any(int(x) > 255 for x in value.split(".")):
                continue
            value = ".".join(str(int(x)) for x in value.split("."))
        elif kind == "ip":
            value = value.lower()
        elif kind == "key":
            kind = "secret"
        found.append((m.start(m.lastgroup), m.end(m.lastgroup), kind, cls, value))
    return found


class Draw:
    """Numbers from a keyed hash of an entity and an attempt."""

    def __init__(self, key: str, *what: object):
        self.seed, self.block, self.left = "\0".join(map(str, what)).encode("utf-8"), 0, 0
        self.key, self.number = hashlib.sha256(key.encode("utf-8")).digest(), 0

    def below(self, n: int) -> int:
        if self.left < 4:
            self.number = int.from_bytes(hashlib.blake2b(self.seed + b"\0%d" % self.block, key=self.key).digest(), "big")
            self.block, self.left = self.block + 1, 60
        self.number, out = divmod(self.number, n)
        self.left -= (n.bit_length() + 7) // 8
        return out

    def like(self, text: str) -> str:
        """A character of the same kind for each letter and digit, of the same script and case; others as they are."""
        out = []
        for c in text:
            if c.isdigit():
                pool = alike(c) if c > "9" else "0123456789"
            elif c in "aeiouy":
                pool = "aeiou"
            elif c in "AEIOUY":
                pool = "AEIOU"
            elif c.isalpha():
                pool = alike(c)
            else:
                pool = c
            out.append(pool[self.below(len(pool))])
        return "".join(out)


@lru_cache(10_000)
def alike(c: str) -> str:
    """Characters of the script, category and case of c."""
    if c.isascii() or "À" <= c <= "ɏ":
        pool = "bcdfghjklmnpqrstvwxz"
    elif "Ѐ" <= c <= "ӿ":
        pool = "бвгдклмнпрст"
    elif "Ͱ" <= c <= "Ͽ":
        pool = "βγδκλμνπρτ"
    else:
        kind = lambda x: (unicodedata.category(x), unicodedata.name(x, "").partition(" ")[0], x.isalpha(), x.isdigit())
        begin = ord(c) & ~63
        return "".join(x for x in map(chr, range(begin, begin + 64)) if kind(x) == kind(c))
    return pool.upper() if c.isupper() else pool


def surrogate(key: str, kind: str, cls: str, value: str, attempt: int) -> str:
    """A candidate in canonical form: keyed, of the type and class of the entity, another for each attempt; from GROW on of more and more characters, so that they never run out."""
    draw = Draw(key, kind, value, attempt)
    if kind in ("given", "surname"):
        script, _, form = cls.partition(" ")
        pool = (GIVEN if kind == "given" else SURNAMES)[script, form]
        name = pool[draw.below(len(pool))]
        if attempt > 1:  # the lists are too short for all: names of two, then invented ones
            name += "-" + pool[draw.below(len(pool))]
        if attempt > 3 and kind == "surname" or attempt > 6:
            name = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(2 + attempt // 4))
            name = name.capitalize() + ENDINGS.get((script, form), "") if kind == "surname" else pool[draw.below(len(pool))] + "-" + name.capitalize()
        return name.casefold()
    more = max(0, (attempt - GROW) // 2 + 1)
    if kind == "email":
        value = value.replace("@", "n" * more + "@", 1)
    elif more and kind == "secret":
        value += "0" * more
    elif more and kind in ("phone", "card", "ssn"):
        value += "0" * more
    elif more and kind == "iban":
        value = (value + "0" * more)[:34]
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        other = Draw(key, "domain", domain, 0)
        labels[:-1] = [x if x in ("example", "co", "com", "org", "ac") else other.like(x) for x in labels[:-1]]
        return draw.like(local) + "@" + ".".join(labels)
    if kind == "phone":
        keep = (value[0] == "+") + int(cls)
        return value[:keep] + draw.like(value[keep:])
    if kind == "card":
        body = value[0] + draw.like(value[1:])
        if cls == "luhn":
            body = next(x for d in "0123456789" if luhn(x := body[:-1] + d))
        return body
    if kind == "ip" and ":" not in value:
        octets = value.split(".")
        keep = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or octets[0] == "172" and 16 <= int(octets[1]) < 32 else 0
        new = octets[:keep]
        while len(new) < 4:
            low, high = (1, 254) if more else (1, 9) if int(octets[len(new)]) < 10 else (10, 99) if int(octets[len(new)]) < 100 else (100, 254)
            new.append(str(low + draw.below(high - low + 1)))
        return ".".join(new)
    if kind == "ip":
        return "".join("0123456789abcdef"[draw.below(16)] if c != ":" else c for c in value)
    if kind == "iban":
        body = value[:2] + "00" + draw.like(value[4:])
        return value[:2] + f"{98 - iban_rest(body):02d}" + body[4:]
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
    return draw.like(value)


def rendered(kind: str, original: str, new: str) -> str:
    """The surrogate in the format of a mention: its separators, its case and the gender of a surname."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new.lstrip("+"))
        return "".join(next(chars) if c.isalnum() else c for c in original) + "".join(chars)
    if kind in ("given", "surname"):
        parts = new.split("-")
        if kind == "surname" and surname_of(original)[2]:
            parts = [feminine(p) for p in parts]
        if original.isupper() and len(original) > 1:
            return "-".join(parts).upper()
        return "-".join(p[:-1].capitalize() + "ς" if p.endswith("σ") else p.capitalize() for p in parts)
    if kind in ("email", "ip") and len(new) == len(original):
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, original))
    return new


def found_in(docs: DataFrame) -> DataFrame:
    """(digest, start, end, kind, cls, value) of the mentions in the distinct texts of docs that may have any."""

    def run(batches):
        names = ["digest", "start", "end", "kind", "cls", "value"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in mentions(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)

    texts = docs.where(F.col("text").rlike(CUE)).select(F.md5("text").alias("digest"), "text")
    return texts.mapInArrow(run, "digest string, start int, end int, kind string, cls string, value string").distinct()


def assigned(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for each distinct entity: distinct in a kind, and none of them an original of it.

    In each round all open entities draw; one that drew an original or the
    surrogate of another, or the same as one of a lesser value, draws again.
    The more often it does, the more surrogates there are, so that it ends.
    """

    @F.pandas_udf("string")
    def draw(kind: pd.Series, cls: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x) for x in zip(kind, cls, value, attempt)], dtype=object)

    entities = cut(found.groupBy("kind", "value").agg(F.min("cls").alias("cls")))
    originals = entities.select("kind", F.col("value").alias("surrogate"))
    done, open_, attempt = None, entities, 0
    while True:
        taken = originals if done is None else originals.union(done.select("kind", "surrogate")).distinct()
        drawn = open_.withColumn("surrogate", draw("kind", "cls", "value", F.lit(attempt)))
        free = drawn.join(taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left").withColumn("n", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value")))
        judged = cut(free.withColumn("won", F.col("taken").isNull() & (F.col("n") == 1)))
        won = judged.where("won").select("kind", "value", "surrogate")
        done = won if done is None else done.union(won)
        open_, attempt = judged.where("not won").select("kind", "value", "cls"), attempt + 1
        if open_.isEmpty():
            return done


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of docs, columns as they are, with surrogates in the place of the entities in text.

    All rows that have equal texts get equal texts. Texts without entities,
    null and empty ones among them, stay byte for byte. n_chars, if there, is
    the length of the new text in rows that changed.
    """
    found = written(found_in(docs), "mentions")
    new = assigned(found, key)
    lists = found.join(new, ["kind", "value"]).groupBy("digest").agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias("__tl_list")).withColumnRenamed("digest", "__tl_digest")

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, lists):
            if found is None:
                out.append(None)
                continue
            parts, last = [], 0
            for m in sorted(found, key=lambda m: m["start"]):
                parts += [text[last : m["start"]], rendered(m["kind"], text[m["start"] : m["end"]], m["surrogate"])]
                last = m["end"]
            out.append("".join([*parts, text[last:]]))
        return pd.Series(out, dtype=object)

    lists = written(lists, "mention-lists")
    side = F.broadcast(lists) if light(lists, "120 + 72 * size(__tl_list)") else lists.hint("shuffle_hash")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select(*columns, F.md5("text").alias("__tl_md5")).join(side, F.expr("__tl_md5 = __tl_digest"), "left")
    touched = F.when(F.col("__tl_list").isNotNull(), F.col("text"))  # only these go to Python
    joined = joined.withColumn("__tl_new", replaced(touched, "__tl_list"))
    values = {"text": F.coalesce("__tl_new", "text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("__tl_new").isNotNull(), F.length("__tl_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudonymised() documents, all of them."""
    return pseudonymised(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
