"""Personal data: high-recall generators propose spans, boosted trees choose among them.

Spans that the fixed patterns verify (addresses, card numbers by checksum and so on) always
stay. Generators propose more spans, overlapping ones too: obfuscated addresses, phone
numbers without a plus, national ids, bank accounts, credentials with or without a word that
announces them. Trees trained on synthetic sentences score each proposal from its format and
the words around it; calibration and thresholds come from other sentences, written by hand,
whose wording and formats the training sentences don't have. A proposal is redacted if the
calibrated score reaches its kind's threshold. Of overlapping proposals the best stays, and
none that overlaps a fixed span.

All patterns run in time linear in the text. Offsets are code points, ends exclusive.

Defined results for odd input: null counts as the empty text, which has no spans; repeated
rows are searched on their own; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boost import Boosted
from .text import Block, per_block

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
BASE_KINDS = KINDS[:4]
LONG = 200  # characters from which on a secret is cut at fixed spans inside it
PRECISION = 0.97  # that a kind's threshold reaches on the hand-written sentences

#: Possessive and guarded forms of the fixed patterns: same matches, no backtracking.
EMAIL_REST = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL, EMAIL_HERE = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL_REST), re.compile(EMAIL_REST)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True

GENERATORS = {
    "email": re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]?(?:\bat\b|@)[\])}]? ?[A-Za-z0-9-]{1,63}(?: ?[\[({]?(?:\bdot\b|\.)[\])}]? ?[A-Za-z0-9-]{1,63}){1,4}+"),
    "phone": re.compile(r"(?<![\w+.-])(?:1[ .-])?\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(
        r"(?i)(?:(?:api|access|secret|auth|private|client|signing|account|storage)[_ -]?key|token|secret|passwd|password|passphrase|passcode|pwd|credentials?)[\"']? ?(?:=>|:=|[=:]) ?"
        r"(?:\"([^\s\"]{8,}+)|'([^\s']{8,}+)|([^\s\"']{8,}+))"
    ),
}
#: How keys begin that need no word to announce them, as their issuers publish it.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza", "eyJ", "npm_", "pypi-", "-----BEGIN ")
KEY_BYTES = [k.encode() for k in KEY_STARTS]
KEY = re.compile(
    r"(?<![A-Za-z0-9_+/=-])(?:" + "|".join(re.escape(k) for k in KEY_STARTS[:-1]) + r")[A-Za-z0-9_.+/=-]{12,}+"
    r"|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s+[A-Za-z-]+: [^\n]*+)*+(?:\s+[A-Za-z0-9+/=]{16,}+)*+(?:\s+[A-Za-z0-9+/=]++(?=\s+-----END))?(?:\s+-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
)
#: Brackets around "at" and "dot" that the e-mail generator accepts.
BRACKETED = re.compile(r"[\[({](?:at\b|dot\b|@)|(?:\bat|\bdot|@)[\])}]")
#: Endings of host names that announce an address.
DOMAINS = frozenset("com co org net edu gov io info biz eu uk de fr es it nl ch at be pl se us ca au in jp br ru cn".split())
CUES = {
    "phone": ("phone", "call", "tel", "mobile", "fax", "dial", "whatsapp", "number"), "email": ("mail", "contact", "write", "reach", "send"), "ssn": ("ssn", "social", "security", "tax"), "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("token", "key", "secret", "passw", "passphrase", "passcode", "pwd", "credential", "auth"), "other": ("version", "order", "invoice", "date", "isbn", "page", "score", "price", "total", "chapter", "ref", "build", "lot", "part", "room", "from", "meet", "look"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := (EMAIL_HERE.match(text, at) if at else None) or EMAIL.search(text, at):
        out.append(m.span())
        at = m.end()
    return out


def base_spans(text: str, digits: bool = True) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if digits:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def proposals(text: str, digits: bool = True) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text or "at" in text:
        bracketed = any(c in text for c in "[](){}") and BRACKETED.search(text)
        if bracketed or ("@" in text or " at " in text) and (" dot " in text or " @ " in text):
            out += [("email", *m.span()) for m in GENERATORS["email"].finditer(text)]
    if digits:
        out += [(k, *m.span()) for k in ("phone", "ssn", "iban") for m in GENERATORS[k].finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", *_trimmed(text, *m.span(m.lastindex), m.lastindex == 3)) for m in GENERATORS["secret"].finditer(text)]
    if any(k in text for k in KEY_STARTS):
        out += [("secret", *_trimmed(text, *m.span(), True)) for m in KEY.finditer(text)]
    return list(dict.fromkeys(out))


def _trimmed(text: str, a: int, b: int, bare: bool) -> tuple[int, int]:
    """Without the punctuation that ends a sentence behind a value in no quotes."""
    while bare and b - a > 8 and text[b - 1] in ".,;:!?)]}>":
        b -= 1
    return a, b


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    n = len(s)
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    counts = list(Counter(s).values())
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    before, after = text[max(0, a - 40) : a].lower(), text[b : b + 24].lower()
    numbers = re.findall(r"[0-9]+", s[:64])
    near = [float(any(w in before for w in words)) for words in CUES.values()] + [float(any(w in after for w in words)) for words in CUES.values()]
    plain = kind == "ssn" and len(numbers) == 3 and numbers[0] not in ("000", "666") and numbers[0] < "900" and numbers[1] != "00" and numbers[2] != "0000"
    checked = kind == "iban" and iban_ok(s) or plain
    classes = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    changes = sum(x.isdigit() != y.isdigit() or x.isupper() != y.isupper() for x, y in zip(s, s[1:64], strict=False))
    word = max(map(len, re.findall(r"[a-z]+", s[:256])), default=0)
    return [
        float(KINDS.index(kind)), n, digits, letters, n - digits - letters, digits / n, entropy, len(groups), groups[0], groups[-1], max(groups), len(counts), float("(" in s), float("." in s), float("-" in s), float(" " in s), float("/" in s),
        float(checked), float(before.endswith(("= ", "=", ": ", ":", '"', "'"))), float(bool(re.search(r"\bat\b", s)) and "@" not in s), float(len(re.findall(r"\bdot\b", s))), float(s[:1] == "0"), float(bool(re.search(r"[\[({]", s))),
        classes, changes, word, float(s.startswith(KEY_STARTS)), float(s.endswith((")", "]", ">", "}"))), float(re.split(r"[^A-Za-z]+", s)[-1].lower() in DOMAINS), *near,
    ]


def _sentence(r: random.Random, lead: str, value: str, tail: str = "") -> tuple[str, int, int]:
    filler = " ".join("".join(r.choice("aeiorstnlmd") for _ in range(r.randint(2, 9))) for _ in range(r.randint(0, 6)))
    head = f"{filler} {lead}".strip()
    text = f"{head}{' ' if head and not head.endswith(chr(34)) else ''}{value}"
    return text + tail + r.choice(["", ".", ", and", " the rest", "!!"]), len(text) - len(value), len(text)


#: Hand-written sentences that calibrate the trees and set the thresholds: kind, whether the
#: marked span is personal data, and the text. # is any digit, @x a value made as named.
HELD = [
    ("phone", 1, "You can ring our office on <(###) 555-####> between nine and five."), ("phone", 1, "Reception: <### ### ####>, ask for Maria."), ("phone", 1, "My cell is <###-###-####> if anything comes up"), ("phone", 1, "text me at <###.###.####>"),
    ("phone", 1, "Customer hotline <0## ### ####> (weekdays)"), ("phone", 1, "Leave a message on <0### ### ####>."), ("phone", 1, "fax no. <(0##) #### ####>"), ("phone", 1, "ph <###-###-####> or come by"), ("phone", 1, "Emergency contact: Dr Lee, <### ###-####>"),
    ("phone", 0, "The tracking code reads <####-###-##> on the parcel."), ("phone", 0, "shipped on <20##-###-##>"), ("phone", 0, "ISBN <###-###-##> was reprinted twice"), ("phone", 0, "The sensor logged <##.###.###> units that night."), ("phone", 0, "chapter <##-###-##> deals with taxes"),
    ("phone", 0, "He won <### ### ###> in the lottery game"), ("phone", 0, "firmware <##.###.##> fixes it"), ("phone", 0, "coordinates <##.####.##> are wrong"), ("phone", 0, "Serial <####/####-##> failed the test"),
    ("email", 1, "Drop a line to <anna.k at example dot org> please."), ("email", 1, "For refunds, <support[at]shop[dot]net>"), ("email", 1, "She uses <j_doe (at) mail (dot) com> these days"), ("email", 1, "press enquiries: <media at news dot co dot uk>"), ("email", 1, "ask <bob{at}work{dot}io>"),
    ("email", 1, "<team @ project.org> answers within a day"), ("email", 1, "Bugs go to <dev(at)kernel.example>"),
    ("email", 0, "We arrived <at noon . Dot> was there"), ("email", 0, "Sold <at 20 . Buyers> lined up"), ("email", 0, "He looked <at dot paintings> for hours"), ("email", 0, "three apples <@ 1.50> each"), ("email", 0, "the <meeting at seven . Bring> notes"), ("email", 0, "stand <still at once . dot> the line"),
    ("ssn", 1, "Her social is <@ssn>, keep it safe."), ("ssn", 1, "Taxpayer <@ssn> filed late"), ("ssn", 1, "Employee record SSN <@ssn>"), ("ssn", 1, "id on file: <@ssn>"), ("ssn", 1, "born 1970, <@ssn>, Ohio"),
    ("ssn", 0, "Section <###-00-####> of the code"), ("ssn", 0, "batch <000-##-####> was recalled"), ("ssn", 0, "model <9##-##-####> ships today"), ("ssn", 0, "item <666-##-####> is sold out"), ("ssn", 0, "catalogue <###-##-0000>"),
    ("iban", 1, "Please wire the rent to <@iban> by Friday."), ("iban", 1, "Donations: <@iban>"), ("iban", 1, "Refund issued to <@iban>, thanks."), ("iban", 1, "our details are <@iban> at the usual branch"),
    ("iban", 0, "Part number <@bad> is out of stock"), ("iban", 0, "Shipment <@bad> left the harbour"), ("iban", 0, "see certificate <@bad>"), ("iban", 0, "licence plate batch <@bad>"),
    ("secret", 1, "export DB_PASSWORD=<@pass>"), ("secret", 1, "password = \"<@pass>\""), ("secret", 1, "the wifi passphrase: <@pass>"), ("secret", 1, "login with pwd='<@pass>'"), ("secret", 1, "client_key => <@code>"), ("secret", 1, "API_TOKEN=<@code>"), ("secret", 1, "auth key: <@hex>"),
    ("secret", 1, "credentials: <@pass>"), ("secret", 1, "{\"secret\": \"<@code>\"}"), ("secret", 1, "leaked <@key> in the log"), ("secret", 1, "I found <@key> on a paste site"), ("secret", 1, "aws configure says <@key>, rotate it"), ("secret", 1, "storage-key: <@hex>"),
    ("secret", 0, "password: <mandatory>"), ("secret", 0, "Enter your password: <carefully> and wait"), ("secret", 0, "token: <identifier> or <literal>"), ("secret", 0, "secret: <ingredients> are love and butter"), ("secret", 0, "The secret: <practising> every single day"), ("secret", 0, "token = <nextToken()> in the parser"),
    ("secret", 0, "password=<your_password>"), ("secret", 0, "API key: <available> on request"), ("secret", 0, "access key: <underneath> the doormat"), ("secret", 0, "private key: <something> you never share"), ("secret", 0, "token := <get_token(request)>"), ("secret", 0, "passcode: <forgotten>"), ("secret", 0, "credentials: <excellent>"),
    ("secret", 0, "password = <os.environ[x]>"), ("secret", 0, "secret: <everybody> knows"), ("secret", 0, "token: <separated-by-commas>"),
]


def held(seed: int = 3, each: int = 12) -> list[tuple[str, str, int, int, int]]:
    """The hand-written sentences with other digits and values each time, as ``examples``."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def iban(off: int) -> str:
        body, country = pick(digits, r.choice([16, 20])), r.choice(["AT", "BE", "IT", "CH", "SE"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return f"{country}{(check + off) % 100:02d}{body}"

    make = {
        "@ssn": lambda: f"{r.randint(1, 665):03d}{(sep := r.choice('- '))}{r.randint(1, 99):02d}{sep}{r.randint(1, 9999):04d}",
        "@iban": lambda: iban(0), "@bad": lambda: iban(r.randint(1, 60)),
        "@pass": lambda: "".join(r.sample(pick(lower, r.randint(4, 8)) + pick(upper, r.randint(1, 3)) + pick(digits, r.randint(2, 4)) + pick("@#%&$*!?", r.randint(1, 3)), k=8 + r.randint(0, 0))) + pick(digits, 2),
        "@code": lambda: pick(lower + upper + digits, r.randint(18, 48)), "@hex": lambda: pick("0123456789abcdef", r.choice([32, 40, 48, 64])),
        "@key": lambda: r.choice(["AKIA" + pick(upper + digits, 16), "ghp_" + pick(lower + upper + digits, 36), "AIza" + pick(lower + upper + digits + "_-", 35), "sk-" + pick(lower + upper + digits, 40)]),
    }
    out = []
    for kind, label, text in HELD:
        for _ in range(each):
            said = re.sub(r"@[a-z]+", lambda m: make[m[0]]() if m[0] in make else m[0], text)
            said = re.sub("#", lambda _: r.choice(digits), said) if kind != "secret" else said
            a, b = said.index("<"), said.rindex(">") - 1
            out.append((kind, said[:a] + said[a + 1 : b + 1] + said[b + 2 :], a, b, label))
    return out


def examples(seed: int = 7, each: int = 500) -> list[tuple[str, str, int, int, int]]:
    """Synthetic sentences made by rule: (kind, text, start, end, label)."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda a=3, b=9: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(a, b)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    code = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789_-") for _ in range(n))

    top = lambda: r.choice(["com", "org", "net", "de", "fr", "info"])
    name = lambda: r.choice([w(), f"{w()}.{w(1, 6)}", f"{w(1, 3)}_{w()}", f"{w()}{d(2)}", f"{w()}-{w()}"])

    def mixed(n: int) -> str:
        """A password: letters of both cases or digits, and signs."""
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ01234567890123456789@#%&$*!?^+=") for _ in range(n - 3)) + r.choice("@#%&$*!") + d(2)

    def iban(good: bool) -> str:
        body, country = d(18), r.choice(["DE", "FR", "ES", "NL", "GB"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        s = f"{country}{check if good else (check + r.randint(1, 60)) % 100:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    yes = {
        "phone": lambda: (r.choice(["call", "phone:", "tel.", "", "my number is", "mobile", "fax", "dial"]), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(201, 989)}-{d(3)}-{d(4)}", f"{r.randint(201, 989)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"{r.randint(201, 989)} {d(3)} {d(4)}"])),
        "email": lambda: (r.choice(["mail", "contact", "write to", "reach me:", "", w()]), r.choice([f"{name()} at {w()} dot {top()}", f"{name()} at {w()} dot {w(2, 3)} dot {top()}", f"{name()}(at){w()}.{top()}", f"{name()}[at]{w()}[dot]{top()}", f"{name()} (at) {w()} (dot) {top()}", f"{name()} @ {w()}.{top()}", f"{name()}{{at}}{w()}{{dot}}{top()}"])),
        "ssn": lambda: (r.choice(["ssn", "social security number", "SSN:", "", "tax id"]), f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"),
        "iban": lambda: (r.choice(["iban", "account", "transfer to", "bank:", ""]), iban(True)),
        "secret": lambda: (r.choice(['token = "', 'api_key: "', 'secret="', "password: ", 'access_key = "', "token = "]), r.choice([hexa(40), hexa(32), code(r.randint(20, 44)), code(r.randint(10, 16)), mixed(r.randint(8, 18)), r.choice(KEY_STARTS[:-1]) + code(r.randint(20, 40))])),
        "key": lambda: (r.choice(["", "see", "here is", "use"]), r.choice(KEY_STARTS[:-1]) + code(r.randint(16, 44))),
    }
    no = {
        "phone": lambda: (r.choice(["order", "on date", "part", "version", "score", "total", "ref", "build", "pages", "invoice", "lot"]), r.choice([f"{r.randint(10, 99)}-{d(3)}-{d(3)}-{d(2)}", f"20{d(2)}-{d(3)}-{d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}/{d(4)}-{d(2)}", f"{d(2)} {d(4)} {d(2)}"])),
        "email": lambda: (r.choice(["we", "look", "meet", "they stay", ""]), r.choice([f"{w()} at {w()} . {w()}", f"{w()} at {w()}. {w().title()}", f"{w()} @ {d(2)}.{d(2)}", f"{w()} at {w()} . {w()} dot {w()}", f"at dot {w()}", f"{w()} at {w()} dot {w()} {w()}", f"{w()} at {w()} . dot {w()}", f"at {d(2)} . {w().title()}"])),
        "ssn": lambda: (r.choice(["order", "part", "build", "ref", "lot"]), r.choice([f"000-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"666 {d(2)} {d(4)}", f"{d(3)}-{d(2)}-0000"])),
        "iban": lambda: (r.choice(["ref", "order", "part", "lot", ""]), iban(False)),
        "secret": lambda: (r.choice(["token: ", "password: ", "secret: ", "token = ", "key is secret: ", "passphrase: ", "api key: "]), r.choice([w(8, 12), f"{w()}_{w()}", "required", f"<{w()}>", f"{w()}-{w()}", "undefined", "optional", f"{w()}({w()})", f"{w()}.{w()}[{w()}]", f"{w()}{w().title()}()", f"{w(8, 12).title()}", f"{w()}-{w(2, 3)}-{w()}", f"{w()}_{w()}_{w()}", f"[{w()}_{w()}]"])),
    }
    out = []
    for kinds, label in ((yes, 1), (no, 0)):
        for kind, make in kinds.items():
            for _ in range(each):
                text, a, b = _sentence(r, *make())
                out.append(("secret" if kind == "key" else kind, text, a, b, label))
    r.shuffle(out)
    return out


def _pieces(used: bytearray, kind: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """What fixed spans leave of a long secret; a shorter one that holds such a span is none."""
    if kind != "secret" or b - a <= LONG:
        return []
    return [(kind, a + m.start(), a + m.end()) for m in re.finditer(rb"\0{8,}+", used[a:b])]


class Model:
    """Trees, calibration and one threshold for each kind."""

    def __init__(self):
        read = lambda rows: (np.array([features(t, k, a, b) for k, t, a, b, _ in rows]), np.array([label for *_, label in rows], float))
        rows = held()
        x, y = read(rows)
        self.trees = Boosted().fit(*read(examples())).calibrate(x, y)
        score = self.trees.predict(x)
        self.threshold = {}
        for k in KINDS:
            mine = np.array([i for i, (name, *_) in enumerate(rows) if name == k], int)
            # the smallest score from which on the kind's precision holds; half way to the next below
            level, at = np.unique(-score[mine], return_inverse=True)
            right = np.cumsum(np.bincount(at, y[mine])) / np.cumsum(np.bincount(at))
            good = np.flatnonzero(right >= PRECISION)
            self.threshold[k] = float(-level[good[-1] : good[-1] + 2].mean()) if len(good) else 1.1

    def choose(self, text: str, base: list[tuple[str, int, int]], proposed: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        used = bytearray(len(text))
        for _, a, b in base:
            used[a:b] = b"\1" * (b - a)
        free = [x for s in proposed for x in ([s] if used.find(1, s[1], s[2]) < 0 else _pieces(used, *s))]
        if not free:
            return []
        score = self.trees.predict(np.array([features(text, *s) for s in free]))
        taken: list[tuple[str, int, int, float]] = []
        for p, s in sorted(zip(score.tolist(), free, strict=True), key=lambda z: (-z[0], z[1][1], -z[1][2], KINDS.index(z[1][0]))):
            if p >= self.threshold[s[0]] and used.find(1, s[1], s[2]) < 0:
                used[s[1] : s[2]] = b"\1" * (s[2] - s[1])
                taken.append((*s, p))
        return taken


@cache
def model() -> Model:
    """Trained where it is used: the sentences come from a seed, so each worker gets the same trees."""
    return Model()


def find(block: Block, i: int, digits: int) -> tuple[str, list, list]:
    raw = block.raw[block.off[i] : block.off[i + 1]].tobytes()
    if digits < 4 and b"@" not in raw and b"=" not in raw and b":" not in raw and b"at" not in raw and not any(k in raw for k in KEY_BYTES):
        return "", [], []
    text = raw.decode("utf-8", "replace")
    base = base_spans(text, digits >= 4)
    proposed = proposals(text, digits >= 4)
    return text, base, model().choose(text, base, proposed) if proposed else []


def _join(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
FIELDS = [(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_spans", T.LongType()), ("found", SPANS)]


def _columns(block: Block, *_):
    digits = block.per_text(DIGIT[block.data])
    counts, sha, every, found = [[] for _ in BASE_KINDS], [], [], []
    for i in range(block.n):
        _, base, more = find(block, i, int(digits[i]))
        for k, c in zip(BASE_KINDS, counts, strict=True):
            c.append(sum(s[0] == k for s in base))
        sha.append(hashlib.sha256(_join(base).encode()).hexdigest())
        spans = sorted([(*s, 1.0) for s in base] + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        every.append(_join([s[:3] for s in spans]))
        found.append([{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in spans])
    return [*counts, sha, every, [len(x) for x in found], found], None


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base counts and digest, all spans as text and as structs with scores."""
    return per_block(docs, [id_col], text_col, _columns, FIELDS)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows as they came, with every span replaced by its kind; the length column follows."""
    hidden = "_redacted"
    while hidden in docs.columns:
        hidden = f"_{hidden}"

    def columns(block: Block, *_):
        digits, out = block.per_text(DIGIT[block.data]), []
        for i in range(block.n):
            text, base, more = find(block, i, int(digits[i]))
            spans = sorted([s[:3] for s in [*base, *more]], key=lambda s: (s[1], -s[2]))
            if not spans:
                out.append(None)
                continue
            parts, at = [], 0
            for k, a, b in spans:
                if a >= at:
                    parts += [text[at:a], f"[{k.upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return [out], None

    new = per_block(docs, docs.columns, text_col, columns, [(hidden, T.StringType())])
    change = {text_col: F.coalesce(hidden, text_col)}
    if length_col and length_col in docs.columns:
        change[length_col] = F.when(F.col(hidden).isNotNull(), F.char_length(hidden)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return new.withColumns(change).drop(hidden).select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
