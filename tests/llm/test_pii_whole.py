"""Personal data: the permutations, every class against brute force, and mentions that the given tables don't hold."""

import itertools
import random
import re
import string
import time
import unicodedata
from collections import Counter

import pytest

from notegrain.llm import pii

KEY = pii.TEST_KEY


def swapped(text):
    return pii.replace(text, KEY)[0]


def only(kind, text):
    found = pii.replace(text, KEY)[1]
    assert [f[0] for f in found] == [kind], (text, found)
    return found[0][3]


def test_permutations():
    step = pii.Permutation(1000, b"k", "t")
    image = [step(x) for x in range(1000)]
    assert sorted(image) == list(range(1000)) and all(x != y for x, y in enumerate(image))
    assert image != [pii.Permutation(1000, b"other", "t")(x) for x in range(1000)]


def test_a_text_of_everything():
    text = 'Mail Ann.Lee7@Mail3.example.com or ann.lee7@mail3.example.com, +1 (614) 555-8001 190.137.223.204, card 4539 1488 0343 6467, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", Sra. Maria Lopez and Sr. Juan Lopez; Mr. Иван Орлов.'
    new, found = pii.replace(text, KEY)
    assert Counter(k for k, *_ in found) == Counter(email=2, phone=1, ip=1, card=1, secret=1, name=3)
    assert all(new[a:b] == s for _, a, b, s in found)
    values = [s for _, _, _, s in found]
    assert values[0].lower() == values[1].lower() and values[0] != values[1]
    digits = values[4].replace(" ", "")
    assert pii._luhn_digit(digits[:-1]) == int(digits[-1]) and values[2].startswith("+1 (")
    given = [v.split()[0] for k, _, _, v in found if k == "name"]
    assert given[0] in pii.NAMES["f", "latin"] and given[1] in pii.NAMES["m", "latin"] and given[2] in pii.NAMES["m", "cyrillic"]
    assert values[6].split()[1] == values[7].split()[1]  # one family, one surrogate
    for e in pii.find_entities(text):
        assert e.text not in new
    for clean in ("Version 2.0 of 2024-01-02, 12:30, 1.2.3 and 3,14; line 1234.", "", "no data", "std::vector, a::b at 12:30:45", "no key: here, it's plain", "The Victor of Rome"):
        assert pii.replace(clean, KEY) == (clean, [])


def samples(rnd):
    """Many entities of each class, written in one way, and other writings of the same ones."""
    d = lambda n: "".join(rnd.choice(string.digits) for _ in range(n))
    word = lambda n, letters=string.ascii_lowercase: "".join(rnd.choice(letters) for _ in range(n))
    yield "email", {m: [m.upper()] for m in (f"{word(2)}{d(1)}@{word(1)}.{top}" for _ in range(300) for top in ("com", "es"))}
    for first in ("10.", "192.168.", "172.16.", "172.31.", "8.", "100.64.", "127.", "169.254."):
        yield "ip", {first + ".".join(str(rnd.randrange(256)) for _ in range(4 - first.count("."))): [] for _ in range(200)}
    yield "ipv6", {f"{p}:{rnd.randrange(1 << 16):x}::{rnd.randrange(1 << 16):x}": [] for p in ("2001:db8", "fe80", "fd00") for _ in range(100)}
    yield "phone", {f"+1 {a} {b} {c}": [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1{a}{b}{c}", f"+1 ({a}) {b}-{c}"] for a, b, c in ((d(3), d(3), d(4)) for _ in range(300))}
    yield "phone", {f"+34 {a} {b} {c}": [f"+34{a}{b}{c}", f"+34-{a}-{b}-{c}"] for a, b, c in ((d(3), d(3), d(3)) for _ in range(300))}
    valid = lambda body: body + str(pii._luhn_digit(body))
    yield "card", {" ".join(re.findall("....", c)): [c, "-".join(re.findall("....", c))] for c in (valid((rnd.choice(("4", "51", "60", "22")) + d(14))[:15]) for _ in range(400))}
    yield "card", {valid("37" + d(12)): [] for _ in range(100)}
    yield "national", {f"{rnd.randrange(1, 600):03d}-{rnd.randrange(1, 99):02d}-{rnd.randrange(1, 9999):04d}": [] for _ in range(300)}
    yield "national", {(n := d(8)) + pii._DNI_LETTERS[int(n) % 23]: [] for _ in range(300)}
    yield "iban", {f"ES{98 - pii._mod_97('ES00' + b):02d}{b}": [" ".join(re.findall(".{1,4}", f"ES{98 - pii._mod_97('ES00' + b):02d}{b}"))] for b in (d(20) for _ in range(200))}
    yield "secret", {f'token = "{word(14)}"': [] for _ in range(200)}
    yield "secret", {word(size, "0123456789abcdef"): [] for size in (32, 40, 48, 56, 64) for _ in range(60)}
    short = ["".join(p).capitalize() for p in itertools.product("abemoz", repeat=3)]
    names = short + pii.NAMES["f", "latin"] + pii.NAMES["m", "latin"] + pii.FAMILY["latin"] + ["Łukasz", "Øyvind", "Groß"]
    yield "name", {f"Mr. {n} Silva": [f"Mrs. {n} Silva", f"Dr {n} Silva", f"Prof. {n.upper()} SILVA"] for n in names}
    yield "name", {f"Dr. {n}": [f"Mr. {n}"] for n in names}
    for letters in ("абвгд", "αβγδε", "王李小明大", "김철수이박", "אבגדה"):
        found = ["".join(p) for p in itertools.product(letters, repeat=3)]
        yield "name", {f"Mr. {n[0].upper() + n[1:]}": [] for n in found}


def test_every_class_by_brute_force():
    """Within a type no two entities share a surrogate, all writings of one share theirs, and none stays."""
    rnd = random.Random(9)
    strip = lambda s: re.sub(r"^\w+\.? ", "", s)
    taken, seen = {}, set()
    for kind, group in samples(rnd):
        for mention, others in group.items():
            core = strip(mention) if kind == "name" else mention
            if (kind, core) in seen:
                continue
            seen.add((kind, core))
            new = only(kind, mention)
            form = pii.canonical(kind, new)
            own = pii.canonical(kind, core)
            assert taken.setdefault((kind, form), own) == own, (kind, mention, new)
            assert form != own
            for other in others:
                assert pii.canonical(kind, only(kind, other)) == form, (mention, other)
            script = unicodedata.name(core[0]).split()[0]
            if kind == "name":
                assert unicodedata.name(new[0]).split()[0] == script
    assert len(taken) > 4000


def test_classes_stay():
    assert all(only("ip", f"192.168.{a}.{a}").startswith("192.168.") for a in range(50))
    assert all(16 <= int(only("ip", f"172.20.{a}.1").split(".")[1]) < 32 for a in range(50))
    began = time.perf_counter()
    for a in range(200):
        only("ip", f"192.168.1.{a}")
    assert time.perf_counter() - began < 1
    public = [only("ip", f"{a}.1.2.3") for a in (1, 9, 11, 99, 126, 128, 171, 193, 223)]
    first = {int(p.split(".")[0]) for p in public}
    assert not first & {0, 10, 127} and max(first) < 224
    assert only("ipv6", "fe80::1").startswith("fe") and only("phone", "+34 612 345 678").startswith("+34 6")
    iban = only("iban", "ES91 2100 0418 4502 0005 1332")
    assert pii._mod_97(iban.replace(" ", "")) == 1 and [len(p) for p in iban.split()] == [4] * 6
    assert swapped("pay ES91 2100 0418 4502 0005 1332 NOW").endswith(" NOW")
    assert pii._is_national(only("national", "12345678Z")) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", only("national", "123-45-6789"))


def test_long_numbers_that_are_no_cards_stay():
    for text in ("4539 1488 0343 6468", "no. 9807915762804490 here", "1234567890123", "4845168114407328"):
        assert pii.replace(text, KEY) == (text, [])
    new = only("card", "4845168114407329")
    assert new.startswith("48") and pii._is_card(new) and len(new) == 16


def test_names():
    assert not set(pii._GIVEN_PLACE) & set(pii._FAMILY_PLACE)
    listed = set(pii._GIVEN_PLACE) | set(pii._FAMILY_PLACE)
    endings = {e for s in pii._SYLLABLES.values() for e in s[2]}
    assert not any(n.endswith(tuple(endings)) for n in listed)
    new = swapped("Dr. Maria Lopez came. Maria Lopez left; Lopez, said MARIA, is Maria. A maria stays, Mariano too.")
    given, family = new.split()[1:3]
    assert given in pii.NAMES["f", "latin"] and family.rstrip(".") in pii.FAMILY["latin"]
    assert new.count(given) == 3 and new.count(family.rstrip(".")) == 3 and "A maria stays, Mariano too." in new
    new = swapped("Mr. Jan Kowalski saw Dr. Jan Kowalski and Jan.")
    words = re.findall(r"[A-Z]\w+", new)
    assert words[1:3] == words[4:6] and words[6] == words[1] and words[1].endswith("ven") and words[2].endswith("dal")
    assert swapped("Mr. José García") == swapped("Mr. Jose Garcia")
    assert swapped("Mr. Ioo and Mrs. Marta").split()[4] in pii.NAMES["f", "latin"]
    new = swapped("Mr. 王小明 here; 王小明先生来了。")
    assert "王小明" not in new and new[4:7] == new[new.index("先生") - 3 : new.index("先生")]
    assert swapped("Ms. Jean-Marie O'Brien").count("-") == 1 and "Brien" not in swapped("Ms. Jean-Marie O'Brien")


def test_secrets():
    text = 'password = "correct_horse_battery" and nothing else'
    replaced, found = pii.replace(text, KEY)
    assert [f[0] for f in found] == ["secret"] and "correct_horse_battery" not in replaced
    assert pii.replace(text + " 7", KEY) == (replaced + " 7", found)
    assert only("secret", "Token: 'abcdefabcdefabcdef'") and only("secret", 'pwd="p@$$w0rd!"') != "p@$$w0rd!"
    assert "пароль" not in swapped('password: "парольпароль"')
    assert all(only("secret", ("0123456789abcdef" * 8)[:n]) for n in range(32, 129))


def test_long_texts_take_one_pass():
    text = " ".join(f"word{k} a{k}@x.org, Dr. Anna Maier{k % 50} and 10.0.{k % 200}.{k % 100};" for k in range(4000))
    began = time.perf_counter()
    new, found = pii.replace(text, KEY)
    assert len(found) == 12_000 and time.perf_counter() - began < 20 and "Maier" not in new


def test_collisions_are_walked_past(spark):
    seen = pii.Collisions()
    for mention in ("10.0.0.1", "10.0.0.01"):  # one address
        pii.replace(mention, KEY, seen)
    text = "mail a.b@c1.example.org"
    first = pii.replace(text, KEY)[1][0][3]
    seen.given["email", first] = "other@c1.example.org"  # as if another entity had got its surrogate
    second = pii.replace(text, KEY, seen)[1][0][3]
    assert second not in (first, "a.b@c1.example.org") and pii.replace(text, KEY, seen)[1][0][3] == second


def test_rows(spark):
    text = 'token = "correct_horse_battery"'
    rows = spark.createDataFrame([(1, text, 5, "a"), (1, text, 5, "b"), (2, None, 7, None), (None, "", 0, "c")], "doc_id long, text string, n_chars int, entities string")
    out = pii.replace_in_rows(rows, KEY)
    assert out.columns == rows.columns
    new = swapped(text)
    assert Counter(map(tuple, out.collect())) == Counter([(1, new, len(new), "a"), (1, new, len(new), "b"), (2, None, 7, None), (None, "", 0, "c")])
    assert pii.surrogates(rows, KEY).where("n_entities = 1").count() == 2
    with pytest.raises(TypeError):
        pii.replace_in_rows(rows)
