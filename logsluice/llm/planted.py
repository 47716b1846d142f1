"""Made-up secrets of many kinds, and things that look like secrets and are none, to fit and test secret scans on."""

from __future__ import annotations

import random
from collections.abc import Callable

SMALL, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = SMALL + CAPITALS + DIGITS
_URL64 = _ALNUM + "-_"
_PLAIN = "amber river stone maple copper falcon harbor lemon meadow north orchid pepper quartz saddle timber velvet walnut yellow".split()
_SYLLABLES = "an ba co de el fi go hu in jo ka le mi no or pa qui ro sa te un vo wi xe yo zu".split()


def _some(rng: random.Random, chars: str, least: int, most: int | None = None) -> str:
    return "".join(rng.choices(chars, k=rng.randint(least, most or least)))


def _word(rng: random.Random) -> str:
    return "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))


def _password(rng: random.Random) -> str:
    """A word with digits and perhaps a sign, or a random string; of letters and digits at all events."""
    if rng.random() < 0.5:
        word = _word(rng) + _word(rng)
        return (word.capitalize() if rng.random() < 0.5 else word) + rng.choice(["", "_", "-", "."]) + _some(rng, DIGITS, 2, 4)
    return _some(rng, _ALNUM, 4, 7) + rng.choice(DIGITS) + rng.choice(SMALL) + _some(rng, _ALNUM + "_-.", 2, 7)


def _pem(rng: random.Random) -> str:
    return "\n".join(["MII" + _some(rng, _ALNUM + "+/", 61), *(_some(rng, _ALNUM + "+/", 64) for _ in range(rng.randint(2, 9))), _some(rng, _ALNUM + "+/", 20, 60)])


#: By kind: (what stands before, the secret, what stands after).
SECRETS: dict[str, Callable[[random.Random], tuple[str, str, str]]] = {
    "bearer": lambda r: (r.choice(["Authorization: Bearer ", "bearer ", "-H 'Authorization: Bearer "]), f"eyJ{_some(r, _URL64, 17, 40)}.eyJ{_some(r, _URL64, 40, 140)}.{_some(r, _URL64, 43)}", r.choice(["", "'"])),
    "prefixed": lambda r: (r.choice(["", "use ", "key ", "= "]), r.choice(["ghp_", "gho_", "glpat-", "npm_", "sk-", "sk_live_", "rk_live_"]) + _some(r, _ALNUM, 20, 40), r.choice(["", ".", ","])),
    "chat": lambda r: (r.choice(["", "bot ", "hook: "]), f"xox{r.choice('bp')}-{_some(r, DIGITS, 11)}-{_some(r, DIGITS, 12)}-{_some(r, _ALNUM, 24)}", ""),
    "cloud": lambda r: (r.choice(["", "key=", "map key "]), "AIza" + _some(r, _URL64, 35), r.choice(["", "&v=3"])),
    "capital hex": lambda r: (r.choice(["", "key is ", "hash ", "id: "]), _some(r, DIGITS + "ABCDEF", r.choice([32, 40, 64])), ""),
    "random": lambda r: (r.choice(["client key is ", "key: ", 'key = "', ""]), _some(r, _ALNUM + "+/", 38, 44), r.choice(["", "=", '="'])),
    "told": lambda r: (r.choice(["the password is ", "password for it is ", "my password was ", "passcode is ", "your new password: ", "login with password "]), _password(r), r.choice([".", "", ",", " now"])),
    "short name": lambda r: (r.choice(["pwd=", "PWD: ", "db_pwd = ", "pwd ", 'pwd="', "smtp_pwd: "]), _password(r), r.choice(["", '"', ";"])),
    "address": lambda r: (f"{r.choice(['postgres', 'https', 'mysql', 'amqp', 'redis'])}://{_word(r)}:", _password(r), f"@{_word(r)}.example:{_some(r, DIGITS, 4)}/{_word(r)}"),
    "private key": lambda r: (f"-----BEGIN {r.choice(['RSA ', '', 'EC '])}PRIVATE KEY-----\n", _pem(r), "\n-----END PRIVATE KEY-----"),
    "passphrase": lambda r: (r.choice(["passphrase: ", 'passphrase = "', "the passphrase is "]), "-".join(r.choices(_PLAIN, k=r.randint(4, 6))), r.choice(["", '"', "."])),
}

#: Kinds that are told by themselves, so that they can stand side by side with nothing but a sign between them.
LISTED = ("bearer", "prefixed", "chat", "cloud", "capital hex", "random")

#: Things that are no secrets, by example.
HARMLESS: list[Callable[[random.Random], str]] = [
    lambda r: f"{r.choice(['call', 'tel:', 'order', 'card', 'no.'])} {_some(r, DIGITS, 3)}-{_some(r, DIGITS, 3, 4)}-{_some(r, DIGITS, 4)}",
    lambda r: _some(r, DIGITS, 8, 19),
    lambda r: f"{_some(r, DIGITS, 1, 3)}.{_some(r, DIGITS, 1, 3)}.{_some(r, DIGITS, 1, 3)}.{_some(r, DIGITS, 1, 3)}",
    lambda r: f"{_word(r)}.{_word(r)}{_some(r, DIGITS, 0, 3)}@{_word(r)}.example",
    lambda r: f"20{_some(r, DIGITS, 2)}-0{r.choice(DIGITS[1:])}-1{r.choice(DIGITS)}T1{r.choice(DIGITS)}:3{r.choice(DIGITS)}:00Z",
    lambda r: f"https://www.{_word(r)}.example/{_word(r)}/{_word(r)}-{_some(r, DIGITS, 2, 6)}?{_word(r)}={_some(r, DIGITS, 1, 5)}",
    lambda r: f"/usr/lib/{_word(r)}-{r.choice(DIGITS)}.{r.choice(DIGITS)}/{_word(r)}_{_word(r)}.so.{r.choice(DIGITS)}",
    lambda r: f"v{r.choice(DIGITS)}.{_some(r, DIGITS, 1, 2)}.{_some(r, DIGITS, 1, 2)}-rc{r.choice(DIGITS)}",
    lambda r: f"{_some(r, CAPITALS, 2)}-{_some(r, DIGITS, 3, 5)}{r.choice(['', '-' + _some(r, CAPITALS, 1, 2)])}",
    lambda r: f"{_word(r)}{_word(r).capitalize()}{_word(r).capitalize()}{r.choice(['', r.choice(DIGITS)])}",
    lambda r: f"{_word(r).upper()}_{_word(r).upper()}_{_some(r, DIGITS, 1, 2)}",
    lambda r: f"the {r.choice(['password', 'token', 'secret', 'passphrase'])} is {r.choice(['required', 'not shown', 'invalid', 'optional here', 'known to few', 'wrong again'])}",
    lambda r: f"{r.choice(['password', 'token', 'secret'])} {r.choice(['reset', 'count', 'service', 'policy', 'of success', 'ring'])} {_some(r, DIGITS, 1, 4)}",
    lambda r: f"{r.choice(['tokens', 'passwords', 'secrets'])}: {_some(r, DIGITS, 1, 5)} {_word(r)} {_word(r)}",
    lambda r: f"{_word(r)}-{_word(r)}-{_word(r)}-{_word(r)}",
    lambda r: f"#{_some(r, DIGITS + 'abcdef', 6)} {_some(r, DIGITS + 'abcdef', 7, 8)}",
    lambda r: "".join(_word(r) for _ in range(r.randint(5, 9))),
    lambda r: (_word(r) + " ") * r.randint(3, 6),
    lambda r: _some(r, "=-_*#", 8, 60),
    lambda r: f"{_word(r)}: {_word(r)} = {_some(r, DIGITS, 1, 6)}",
    lambda r: f"x{_some(r, DIGITS, 2)}_{_some(r, DIGITS, 2)} {_some(r, CAPITALS, 1)}{_some(r, DIGITS, 1, 3)} {_some(r, DIGITS, 1, 2)}th {_some(r, DIGITS, 1, 3)}kg",
]


def planted(text: str, rng: random.Random, kinds: list[str], harmless: int = 2, listed: tuple[str, ...] | list[str] = ()) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
    """The text with a secret of each kind, and so many harmless things, set in at random gaps between words, and the listed kinds side by side; the secrets' spans, and those of all that was set in."""
    gaps = [0, *(k + 1 for k, c in enumerate(text) if c in " \n"), len(text)]
    wanted = [SECRETS[k](rng) for k in kinds] + [(HARMLESS[rng.randrange(len(HARMLESS))](rng), "", "") for _ in range(harmless)]
    places = [(rng.choice(gaps), k) for k in range(len(wanted))]
    if listed:
        at, sign = rng.choice(gaps), rng.choice(["", ",", "\n"])
        places += [(at, len(wanted) + k) for k in range(len(listed))]
        wanted += [("", SECRETS[k](rng)[1], sign) for k in listed]
    places.sort()
    named = [*kinds, *[""] * harmless, *listed]
    out, spans, regions, last, size = [], [], [], 0, 0
    for at, k in places:
        before, secret, after = wanted[k]
        lead = text[last:at] + ("" if not at or text[at - 1] in " \n" else " ")
        out += [lead, before, secret, after + " "]
        start = size + len(lead) + len(before)
        if secret:
            spans.append((start, start + len(secret), named[k]))
        regions.append((size + len(lead), start + len(secret) + len(after)))
        size = start + len(secret) + len(after) + 1
        last = at
    return "".join([*out, text[last:]]), spans, regions
