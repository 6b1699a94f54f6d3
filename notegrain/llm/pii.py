"""Surrogates for personal data: keyed, type-consistent, matching format, script and gender.

Entities are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, IBANs, national ids (US, Spain), card numbers (the
last three with right check digits or parts, so other long numbers stay), secrets (keys, tokens) and names. An entity's canonical form (case, accents, separators and country code style aside) is
a number in the range of its class: digits of a given count, the addresses of one network, the names of one script. The
surrogate is the image of that number under a keyed permutation of that very range, so within a class equal entities get
equal surrogates (coreference, in this and in any other document, without a table of entities) and different ones
different surrogates. The permutation is E^-1(E(x) + 1), E a Feistel network with cycle walking; it has no fixed point, so
nothing is replaced by itself. Ranges are indexed (a private network, valid phone numbers, card numbers of one check
digit), not searched, so a mention takes a few Feistel steps. Case and separators of the mention are put back.

Names are found after (or, in Chinese, before) a title, or as a listed given name and a family name; the same full name,
and its parts, are then found again anywhere in the document. A listed given name becomes another one of its gender and
script, a listed family name another of its script. Other names are numbered within their script and written as
syllables: given names end in -vena where the name ends in a (or its like) and in -ven elsewhere, family names in -dal, so
the classes share no surrogate, no list has such names, and a name's surrogate doesn't hang on its title. In scripts
without a table of syllables, letters are permuted within their script.

A check of every batch's replacements makes sure that no two entities of one type share a surrogate; should they ever,
the later one goes on along its permutation. There is no shuffle. The key is the caller's: whoever has it can undo the
permutations.

Defined results: null text stays null with no entities; empty text stays empty; documents are independent, repeated rows
are treated alike; where two kinds of entity overlap, the first kind listed wins; very long texts are taken whole, each
pattern in one pass; an empty table gives an empty table; columns of other names don't matter.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrain.llm._common import id_and_text, pieces, table

#: For tests and the registered queries only; production passes a secret of its own.
TEST_KEY = b"notegrain surrogate key"
_ROUNDS = 8

#: Given names by gender and script, without accents.
NAMES = {
    ("f", "latin"): "Alba Alice Alicia Amelia Amy Ana Andrea Anna Antonia Barbara Beatriz Camila Carla Carmen Carolina Catalina Charlotte Christine Clara Claudia Cristina Daniela Diana Elena Elizabeth Emily Emma Eva Francesca Gabriela Giulia Hanna Heidi Ines Irene Isabel Jessica Johanna Julia Karen Katharina Laura Linda Lisa Lucia Luisa Margarita Maria Marta Mary Monica Natalia Nora Olga Olivia Patricia Paula Petra Pilar Raquel Rosa Sandra Sara Sofia Sophie Susan Teresa Ursula Valentina Vera Victoria".split(),
    ("m", "latin"): "Adam Alberto Alejandro Alexander Andres Anthony Antonio Arthur Benjamin Bernard Carlos Charles Christian Daniel David Diego Eduardo Emil Enrique Felipe Felix Fernando Francisco Frank Franz Gabriel George Giovanni Hans Henry Hugo Ignacio Ivan Jack James Javier John Jonas Jorge Jose Juan Karl Klaus Leo Louis Luca Luis Manuel Marco Mario Matthias Max Michael Miguel Nicolas Oscar Pablo Paul Pedro Peter Pierre Rafael Ramon Robert Roberto Samuel Sergio Stefan Thomas Tomas Victor William".split(),
    ("f", "cyrillic"): "Алла Анастасия Анна Валентина Вера Галина Дарья Елена Ирина Ксения Людмила Марина Мария Надежда Наталья Нина Ольга Светлана София Софья Тамара Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексеи Андреи Антон Борис Виктор Владимир Денис Дмитрии Иван Игорь Кирилл Максим Михаил Николаи Олег Павел Петр Роман Сергеи Степан Юрии".split(),
    ("f", "greek"): "Αννα Βασιλικη Γεωργια Δημητρα Ειρηνη Ελενη Ιωαννα Κατερινα Μαρια Σοφια Φωτεινη Χριστινα".split(),
    ("m", "greek"): "Αθανασιος Ανδρεας Βασιλης Γεωργιος Γιαννης Δημητρης Ιωαννης Κωστας Μιχαλης Νικος Παναγιωτης Πετρος".split(),
}
#: Family names by script, without accents.
FAMILY = {
    "latin": "Adler Alonso Alvarez Anderson Bauer Becker Bianchi Blanco Brown Castillo Castro Clark Costa Cruz Davis Delgado Diaz Dominguez Esposito Evans Fernandez Ferrari Ferrer Fischer Garcia Gil Gomez Gonzalez Gutierrez Hall Harris Hernandez Herrera Hoffmann Iglesias Jackson Jimenez Johnson Jones Keller Koch Lee Lewis Lopez Martin Martinez Meyer Miller Molina Moore Morales Moreau Moreno Munoz Navarro Ortega Ortiz Pascual Perez Ramirez Ramos Reyes Rivera Robinson Rodriguez Romero Rossi Rubio Ruiz Sanchez Santos Schmidt Schneider Schulz Serrano Silva Smith Suarez Taylor Torres Vargas Vazquez Vega Wagner Walker Weber White Williams Wilson Wright Young Zimmermann".split(),
    "cyrillic": "Белов Васильев Волков Громов Егоров Заицев Иванов Козлов Кузнецов Лебедев Морозов Новиков Орлов Павлов Петров Попов Семенов Смирнов Соколов Федоров".split(),
    "greek": "Αλεξιου Αντωνιου Βασιλειου Γεωργιου Δημητριου Δημου Ιωαννου Κωνσταντινου Νικολαου Παπαδοπουλος Παυλου Πετρου".split(),
    "han": list("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余"),
}
#: Titles.
TITLES = "Mr Mrs Ms Mx Miss Dr Dra Sr Sra Srta Doña Herr Frau Madame Mme Mlle Monsieur Prof Profa Signora Signor Господин Госпожа Κύριος Κυρία".split()
#: Telephone country codes of one and two digits; all others have three.
_COUNTRY_1 = {"1", "7"}
_COUNTRY_2 = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Check letters of Spanish ids.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Syllables that other names are written in: beginnings and vowels; then the endings of given names (like f, others) and families.
_SYLLABLES = {
    "latin": ("b c d f g h j k l m n p r s t v z br ch cl cr dr fr gl gr kr pl pr sh st th tr".split(), "aeiou", ("vena", "ven", "dal")),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ч ш бр гр др кр пр ст тр".split(), "аеиоу", ("вена", "вен", "даль")),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ βρ γρ δρ κρ πρ στ τρ".split(), "αεηιου", ("βενα", "βεν", "δαλη")),
}
#: Endings by which a given name counts as a woman's.
_LIKE_F = {"latin": "a", "cyrillic": "ая", "greek": "αη"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX4 = r"[0-9A-Fa-f]{1,4}"
_UPPER = r"[^\W\d_a-zß-öø-ÿа-яёα-ωάέήίόύώ]"
_MARKS = r"\u0300-\u036f\u0900-\u0963\u0e31-\u0e4e"
_WORD = rf"{_UPPER}[\w{_MARKS}]*(?:['’-]{_UPPER}[\w{_MARKS}]*)*"
_HAN = r"[一-鿿]"
#: The one secret that needs no digit.
QUOTED_SECRET = re.compile(r"(?i:(?P<short>secret|password|passwd|pwd)|token|key)[\"']?\s{0,3}[=:]\s{0,3}[\"'](?P<value>(?(short)[^\s\"']{8,}|[^\s\"']{12,}))[\"']")
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])")),
    ("secret", QUOTED_SECRET),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?P<value>[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("ipv6", re.compile(rf"(?<![\w:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}|(?:{_HEX4}:){{2,7}}:|::(?:{_HEX4}:){{1,6}}{_HEX4})(?![\w:])")),
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)")),
    ("national", re.compile(r"(?<![\w.+-])(?:\d{3}-\d{2}-\d{4}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z])(?![\w-])")),
    ("card", re.compile(r"(?<![\d.+-])(?=4|5[0-8]|2[2-7]|3[0-9]|6[0-9])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d]|[.-]\d)")),
    ("phone", re.compile(r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.+-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d.-])")),
)
_TITLED = re.compile(rf"\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?P<value>{_HAN}{{2,3}}|{_WORD}(?: {_WORD}){{0,2}})|(?P<before>[{''.join(FAMILY['han'])}]{_HAN}{{1,2}})(?=先生|女士|小姐)")
_PAIR = re.compile(r"(?<!\w)(?P<given>[A-ZÀ-ÞА-ЯΑ-Ω][\w]{3,}) (?P<family>[A-ZÀ-ÞА-ЯΑ-Ω]\w{2,})")


class Entity(NamedTuple):
    """A detected mention; given: a word alone that the document also has as somebody's first name."""

    kind: str
    start: int
    end: int
    text: str
    given: bool = False


def folded(word: str) -> str:
    """Case folded; Latin, Greek and Cyrillic letters without accents."""
    plain = (unicodedata.normalize("NFD", c)[0] if c < "\u2000" else c for c in word.casefold() if not "\u0300" <= c <= "\u036f")
    return "".join(plain)


def _tongue(letter: str) -> str:
    return unicodedata.name(letter, "").split(" ")[0]


def script_of(word: str) -> str:
    """latin, cyrillic, greek, han, hangul, or the first letter's block of 128 code points and the first word of its name."""
    point = ord(word[0])
    if 0xAC00 <= point < 0xD7A4:
        return "hangul"
    if point < 0x250 or 0x1E00 <= point < 0x1F00:
        return "latin"
    if 0x370 <= point < 0x400 or 0x1F00 <= point < 0x2000:
        return "greek"
    return "cyrillic" if 0x400 <= point < 0x530 else "han" if 0x4E00 <= point < 0xA000 else f"block {point >> 7} {_tongue(word[0])}"


def _placed(names: dict) -> dict:
    """Folded name to (class, place, size)."""
    return {folded(n): (k, i, len(listed)) for k, listed in names.items() for i, n in enumerate(listed)}


_GIVEN_PLACE, _FAMILY_PLACE = _placed(NAMES), _placed(FAMILY)


def _mod_97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _luhn_digit(body: str) -> int:
    """Check digit of the digits before it."""
    doubled = [int(d) * (2 - k % 2) for k, d in enumerate(reversed(body))]
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


def _bare(mention: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", mention)


def _is_national(mention: str) -> bool:
    bare = _bare(mention)
    if bare.isdigit():
        return bare[:3] not in ("000", "666") and bare[0] != "9" and bare[3:5] != "00" and bare[5:] != "0000"
    return _DNI_LETTERS[int(bare[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == bare[-1]


def _is_ipv6(mention: str) -> bool:
    try:
        ipaddress.IPv6Address(mention)
    except ValueError:
        return False
    return len(mention) > 5 and any(c.isdigit() for c in mention)


def _is_card(mention: str) -> bool:
    """Whether the check digit is right; other long numbers are no cards."""
    digits = re.sub(r"\D", "", mention)
    return int(digits[-1]) == _luhn_digit(digits[:-1])


def _iban_length(mention: str) -> int:
    """Length of the IBAN that a mention begins with, as words in capitals may follow; 0: none."""
    for end in [len(mention), *reversed([m.start() for m in re.finditer(" ", mention)])]:
        if 15 <= len(_bare(mention[:end])) <= 34 and _mod_97(_bare(mention[:end])) == 1:
            return end
    return 0


#: How much of a match is an entity; of other kinds all is.
_LENGTH: dict[str, Callable[[str], int]] = {"iban": _iban_length, "card": lambda m: len(m) * _is_card(m), "national": lambda m: len(m) * _is_national(m), "ipv6": lambda m: len(m) * _is_ipv6(m)}


def _find_names(text: str) -> list[tuple[int, int, bool]]:
    """Names by title or list, then the same names (of titled ones also parts) anywhere: start, end, given name alone."""
    titled = []
    if any(t in text for t in TITLES) or "先生" in text or "女士" in text or "小姐" in text:
        titled = [m.span("value") if m["value"] else m.span("before") for m in _TITLED.finditer(text)]
    spans = {*titled, *(m.span() for m in _PAIR.finditer(text) if folded(m["given"]) in _GIVEN_PLACE)}
    if not spans:
        return []
    names = {text[a:b] for a, b in spans}
    givens = {n.split(" ")[0] for n in names if " " in n}
    names |= {w for a, b in titled for w in text[a:b].split(" ") if len(w) > 2}
    by_first: dict[str, list[str]] = {}
    for name in sorted(names, key=lambda n: (-len(n), n)):
        if script_of(name) == "han":
            spans |= {m.span() for m in re.finditer(re.escape(name), text)}
        else:
            by_first.setdefault(name.split(" ")[0], []).append(name)
    for m in re.finditer(r"\w[\w'’-]*", text):
        word = m[0] if m[0] in by_first else re.split("['’-]", m[0])[0]
        for name in by_first.get(word, ()):
            end = m.start() + len(name)
            if text.startswith(name, m.start()) and not text[end : end + 1].isalnum():
                spans.add((m.start(), end))
                break
    out: list[tuple[int, int, bool]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, text[a:b] in givens))
    return out


def find_entities(text: str) -> list[Entity]:
    """Mentions in order; none overlap."""
    taken: list[Entity] = []
    digits = re.search(r"\d", text) is not None
    # what must be in a text for a pattern to be worth trying
    quoted = ("=" in text or ":" in text) and ('"' in text or "'" in text)
    worth = {"email": "@" in text, "ipv6": "::" in text or text.count(":") > 6}
    free = text

    def take(kind: str, spans: list) -> None:
        nonlocal free
        parts, at = [], 0
        for start, end, *given in spans:
            taken.append(Entity(kind, start, end, text[start:end], *given))
            # what is taken is hidden from the patterns to come
            parts += [free[at:start], "\0" * (end - start)]
            at = end
        free = "".join(parts) + free[at:] if spans else free

    for kind, pattern in PATTERNS:
        if not (quoted if pattern is QUOTED_SECRET else worth.get(kind, digits)):
            continue
        group = "value" if "value" in pattern.groupindex else 0
        found = list(pattern.finditer(free))
        if kind == "secret" and pattern is not QUOTED_SECRET:  # plain hex: letters as well as digits
            found = [m for m in found if not m[group].isdigit() and not m[group].isalpha()]
        if kind in _LENGTH:
            take(kind, [(m.start(), m.start() + n) for m in found if (n := _LENGTH[kind](m[0]))])
        else:
            take(kind, [m.span(group) for m in found])
    take("name", _find_names(free))
    return sorted(taken, key=lambda e: e.start)


class Permutation:
    """A keyed permutation of range(n) without fixed points (n > 1)."""

    def __init__(self, n: int, key: bytes, tweak: str):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.key = hmac.digest(key, tweak.encode(), "sha256")

    def _round(self, k: int, x: int) -> int:
        need = (self.half + 7) // 8
        data = hashlib.shake_128(self.key + bytes([k]) + x.to_bytes(need, "big")).digest(need)
        return int.from_bytes(data, "big") & ((1 << self.half) - 1)

    def _once(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & ((1 << self.half) - 1)
        for k in range(_ROUNDS):
            a, b = (b ^ self._round(_ROUNDS - 1 - k, a), a) if back else (b, a ^ self._round(k, b))
        return a << self.half | b

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, False) + 1) % self.n, True)


def _permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    return Permutation(n, key, tweak)(x)


def _put_back(mention: str, bare: str) -> str:
    """Letters and digits of a mention replaced, its separators and case kept."""
    rest = iter(bare)
    out = []
    for c in mention:
        if c.isalnum():
            new = next(rest)
            c = new.upper() if c.isupper() else new.lower() if c.islower() else new
        out.append(c)
    return "".join(out)


def _mixed_radix(symbols: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """One number over all places; place k takes a symbol of alphabets[k]."""
    x, n = 0, 1
    for c, alphabet in zip(symbols, alphabets, strict=True):
        x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
    y, out = (_permuted(x, n, key, tweak) if n > 1 else x), []
    for alphabet in reversed(alphabets):
        y, d = divmod(y, len(alphabet))
        out.append(alphabet[d])
    return "".join(reversed(out))


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _alphanumeric(mention: str, key: bytes, kind: str, marks: str = "") -> str:
    """ASCII letters stay letters, digits digits, marks marks, letters of other scripts such; all else in place."""
    lowered = "".join(c.lower() if c.isascii() else c for c in mention)

    def alphabet(c: str) -> str:
        for known in (_DIGITS, _LETTERS, marks):
            if c in known:
                return known
        letters = _letters(script_of(c)) if c.isalpha() else ""
        return letters if c in letters else c

    alphabets = [alphabet(c) for c in lowered]
    shape = "".join("0" if a is _DIGITS else "a" if a is _LETTERS else "." if len(a) > 1 else a for a in alphabets)
    made = _mixed_radix(lowered, alphabets, key, kind + shape)
    return "".join(a.upper() if b.isascii() and b.isupper() else a for a, b in zip(made, mention, strict=True))


def _hex(mention: str, key: bytes) -> str:
    """Digits and letters of the same case; walked on past tokens of digits alone, which aren't of this kind."""
    size = len(mention)
    step = Permutation(16**size, key, f"hex{size}")
    made = f"{step(int(mention, 16)):0{size}x}"
    while made.isdigit() or made.isalpha():
        made = f"{step(int(made, 16)):0{size}x}"
    return made.upper() if mention.upper() == mention else made


def _email(mention: str, key: bytes) -> str:
    body, dot, top = mention.rpartition(".")
    return _alphanumeric(body, key, "email" + top.lower()) + dot + top


def _secret(mention: str, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]{12,}|[0-9A-F]{12,}", mention) and not mention.isdigit() and not mention.isalpha():
        return _hex(mention, key)
    return _alphanumeric(mention, key, "secret", "!#$%&()*+,-./:;<=>?@[]^_{|}~")


#: Networks that keep to themselves: private, shared, loopback, link-local, unspecified, multicast and above.
_NETWORKS = sorted((int(n.network_address), n.num_addresses) for n in map(ipaddress.IPv4Network, ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")))
_FIRST = [a for a, _ in _NETWORKS]
_BEFORE = [sum(n for _, n in _NETWORKS[:k]) for k in range(len(_NETWORKS) + 1)]


def _ip(mention: str, key: bytes) -> str:
    x = 0
    for part in mention.split("."):
        x = x << 8 | int(part)
    k = bisect_right(_FIRST, x) - 1
    first, size = _NETWORKS[k]
    if x < first + size:
        y = first + _permuted(x - first, size, key, f"ip{first}")
    else:  # public: numbered without the networks
        y = _permuted(x - _BEFORE[k + 1], 2**32 - _BEFORE[-1], key, "ip")
        for start, n in _NETWORKS:
            y += n if y >= start else 0
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


#: Prefixes that an IPv6 address keeps, with their lengths: global, unique local, link-local, multicast; of others the first 16 bits.
_PREFIXES = ((0x2000, 3), (0xFC00, 7), (0xFE80, 10), (0xFF00, 8))


def _ipv6(mention: str, key: bytes) -> str:
    x = int(ipaddress.IPv6Address(mention))
    bits = next((n for p, n in _PREFIXES if x >> 112 >> (16 - n) == p >> (16 - n)), 16)
    rest = 128 - bits
    top = x >> rest
    made = str(ipaddress.IPv6Address(top << rest | _permuted(x & ((1 << rest) - 1), 1 << rest, key, f"ipv6 {bits} {top}")))
    return made.upper() if mention.upper() == mention and re.search("[A-F]", mention) else made


def _card(mention: str, key: bytes) -> str:
    """The first two digits, which tell the kind of issuer, stay, and the check digit is right."""
    digits = re.sub(r"\D", "", mention)
    size = len(digits) - 3
    body = digits[:2] + f"{_permuted(int(digits[2:-1]), 10**size, key, f'card{size}/{digits[:2]}'):0{size}d}"
    return _put_back(mention, f"{body}{_luhn_digit(body)}")


def _iban(mention: str, key: bytes) -> str:
    bare = _bare(mention)
    body = _alphanumeric(bare[4:], key, "iban" + bare[:2])
    check = 98 - _mod_97(bare[:2] + "00" + body)
    return _put_back(mention, f"{bare[:2]}{check:02d}{body}")


def _national(mention: str, key: bytes) -> str:
    bare = _bare(mention)
    if bare.isdigit():  # area 001 to 899 but 666, group from 01, serial from 0001
        area, group, serial = int(bare[:3]), int(bare[3:5]), int(bare[5:])
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        y, serial = divmod(_permuted(x, 898 * 99 * 9999, key, "ssn"), 9999)
        area, group = divmod(y, 99)
        return _put_back(mention, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")
    first, number = (bare[0], bare[1:-1]) if bare[0] in "XYZ" else ("", bare[:-1])
    size = len(number)
    made = f"{_permuted(int(number), 10**size, key, 'dni' + first):0{size}d}"
    whole = int((first.translate(str.maketrans("XYZ", "012")) or "") + made)
    return _put_back(mention, first + made + _DNI_LETTERS[whole % 23])


def _phone_parts(mention: str) -> tuple[str, str]:
    """Country code and the number within the country; ten digits without a code are of country 1."""
    digits = re.sub(r"\D", "", mention)
    if not mention.startswith("+"):
        return "1", digits
    size = 1 if digits[0] in _COUNTRY_1 else 2 if digits[:2] in _COUNTRY_2 else 3
    return digits[:size], digits[size:]


def _phone(mention: str, key: bytes) -> str:
    country, number = _phone_parts(mention)
    prefix = len(re.sub(r"\D", "", mention)) - len(number)
    if country == "1" and len(number) == 10:  # area and exchange are from 200 on, or both stay below
        sizes = [800 if number[k] >= "2" else 200 for k in (0, 3)]
        lows = [1000 - 800 if s == 800 else 0 for s in sizes]
        x = ((int(number[:3]) - lows[0]) * sizes[1] + int(number[3:6]) - lows[1]) * 10_000 + int(number[6:])
        y, line = divmod(_permuted(x, sizes[0] * sizes[1] * 10_000, key, f"phone1 {sizes}"), 10_000)
        area, exchange = divmod(y, sizes[1])
        made = f"{area + lows[0]:03d}{exchange + lows[1]:03d}{line:04d}"
    else:  # the first digit tells the kind of line
        size = len(number) - 1
        made = number[:1] + (f"{_permuted(int(number[1:]), 10**size, key, f'phone{country}/{number[0]}/{size}'):0{size}d}" if size > 0 else "")
    return _put_back(mention, re.sub(r"\D", "", mention)[:prefix] + made)


@cache
def _letters(script: str) -> str:
    """Letters of a script: plain ones of those with syllables, all of Han and Hangul, lower-case or caseless ones of other blocks."""
    if script == "han":
        return "".join(map(chr, range(0x4E00, 0x9FA6)))
    if script == "hangul":
        return "".join(map(chr, range(0xAC00, 0xD7A4)))
    if script in _SYLLABLES:
        known = {"latin": (*range(0x61, 0x7B), *range(0xDF, 0x250)), "cyrillic": range(0x430, 0x460), "greek": range(0x3AC, 0x400)}[script]
        return "".join(chr(p) for p in known if chr(p).isalpha() and folded(chr(p)) == chr(p))
    _, block, name = script.split(" ")
    points = range(int(block) << 7, (int(block) + 1) << 7)
    return "".join(chr(p) for p in points if chr(p).isalpha() and chr(p).lower() == chr(p) and _tongue(chr(p)) == name)


def _spelled(y: int, script: str) -> str:
    """A number as syllables, each number otherwise."""
    begin, vowels, _ = _SYLLABLES[script]
    n, out = len(begin) * len(vowels), []
    y += 1
    while y:  # bijective numeration
        y, d = divmod(y - 1, n)
        out.append(begin[d // len(vowels)] + vowels[d % len(vowels)])
    return "".join(reversed(out))


def _unlisted(word: str, script: str, ending: int, key: bytes) -> str:
    """Syllables for a folded name; ending: 0, 1 given names, 2 family names. Words with other marks permute their letters."""
    letters = _letters(script)
    if script not in _SYLLABLES or not set(word) <= set(letters):
        alphabets = [letters if c in letters else c for c in word]
        return _mixed_radix(word, alphabets, key, f"{script} " + "".join("." if len(a) > 1 else a for a in alphabets))
    plain = script == "latin" and word.isascii()
    letters = _LETTERS if plain else letters
    x, n = 0, len(letters) ** len(word)
    for c in word:
        x = x * len(letters) + letters.index(c)
    y = _permuted(x, n, key, f"{script}{ending}{plain}{len(word)}")
    y += sum(len(letters) ** k for k in range(1, len(word)))  # shorter names come before
    # even numbers are names of plain letters, odd ones all others
    return _spelled(2 * y + (not plain), script) + _SYLLABLES[script][2][ending]


def _like(new: str, mention: str) -> str:
    return new.upper() if mention.isupper() and len(mention) > 1 else new.capitalize() if mention[:1].isupper() else new


def _name_word(word: str, key: bytes, family: bool) -> str:
    low, script = folded(word), script_of(word)
    for places, names, kind in ((_FAMILY_PLACE, FAMILY, "family"), (_GIVEN_PLACE, NAMES, "given"))[:: 1 if family else -1]:
        if low in places and (family or kind == "given" or script == "han"):
            group, at, size = places[low]
            return _like(names[group][_permuted(at, size, key, f"{kind}{group}")], word)
    return _like(_unlisted(low, script, 2 if family else 0 if low[-1:] in _LIKE_F.get(script, "") else 1, key), word)


def _name(mention: str, key: bytes, given: bool = False) -> str:
    """Given name, then family names; a word alone is a family name unless known to be given. Parts at a hyphen or apostrophe go alone."""
    if script_of(mention) == "han":
        first = mention[0]
        if first in _FAMILY_PLACE:
            _, at, size = _FAMILY_PLACE[first]
            return FAMILY["han"][_permuted(at, size, key, "familyhan")] + (_unlisted(mention[1:], "han", 1, key) if len(mention) > 1 else "")
        return _unlisted(mention, "han", 1, key)
    words = mention.split(" ")
    return " ".join("".join(p if k % 2 else _name_word(p, key, at > 0 or len(words) == 1 and not given) for k, p in enumerate(re.split(r"(['’-])", w)) if p) for at, w in enumerate(words))


_MAKERS: dict[str, Callable[[str, bytes], str]] = {"email": _email, "secret": _secret, "iban": _iban, "ipv6": _ipv6, "ip": _ip, "national": _national, "card": _card, "phone": _phone}


def surrogate(entity: Entity, key: bytes) -> str:
    """The replacement of one mention."""
    return _name(entity.text, key, entity.given) if entity.kind == "name" else _MAKERS[entity.kind](entity.text, key)


def canonical(kind: str, mention: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("card", "iban", "national"):
        return _bare(mention).lower()
    if kind == "phone":
        return " ".join(_phone_parts(mention))
    if kind == "ip":
        return ".".join(str(int(p)) for p in mention.split("."))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(mention))
    return folded(mention) if kind == "name" else mention.lower()


class Collisions:
    """Surrogates given in one batch, by type, so bounded by the batch: no two entities share one."""

    def __init__(self) -> None:
        self.given: dict[tuple[str, str], str] = {}

    def checked(self, entity: Entity, replacement: str, key: bytes) -> str:
        """The replacement, or, if another entity has it, the first one free along its permutation."""
        own = canonical(entity.kind, entity.text)
        while self.given.setdefault((entity.kind, canonical(entity.kind, replacement)), own) != own:
            before, replacement = replacement, surrogate(entity._replace(text=replacement), key)
            if replacement == before:  # nothing to choose from
                break
        return replacement


def replace(text: str | None, key: bytes, seen: Collisions | None = None) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (type, start, end in the new text, surrogate) of each."""
    if not text:
        return text, []
    seen = seen or Collisions()
    parts, out, at, length = [], [], 0, 0
    for entity in find_entities(text):
        new = seen.checked(entity, surrogate(entity, key), key)
        parts += [text[at : entity.start], new]
        length += entity.start - at
        out.append((entity.kind, length, length + len(new), new))
        at, length = entity.end, length + len(new)
    return "".join(parts) + text[at:], out


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, entities (type, start, end, surrogate) of each row."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            seen = Collisions()
            done = [replace(t.as_py(), key, seen) for t in batch.column(1)]
            spans = [[{"type": a, "start": b, "end": c, "surrogate": d} for a, b, c, d in x[1]] for x in done]
            counts = pa.array([len(x[1]) for x in done], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in done], pa.string()), counts, pa.array(spans, kind)], ["doc_id", "text", "n_entities", "entities"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, text string, n_entities long, entities array<struct<type: string, start: int, end: int, surrogate: string>>")


def replace_in_rows(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents' rows with surrogates in their texts; n_chars, where there is such a column, follows the text.

    Null texts stay null and keep their n_chars, repeated rows stay repeated, an empty table stays empty with its columns.
    """

    @F.pandas_udf("string")
    def replaced(texts):  # noqa: ANN001, ANN202
        seen = Collisions()
        return texts.map(lambda t: replace(t, key, seen)[0], na_action="ignore")

    columns = docs.columns
    out = docs.withColumn("text", replaced(F.col("text").cast("string")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surrogates of the whole documents table, under the key for tests."""
    return surrogates(table(spark, sf_dir, "documents"), TEST_KEY)
