"""Made-up lines with and without secrets, which the field is trained on."""

from __future__ import annotations

import numpy as np

# Words of everyday texts and code, from which lines and passphrases are put together.
WORDS = """
about above access after again all also always amount and animal answer any apple are area article ask at author
baby back bank battery be because before begin below best better between big bird black blue board boat body book
box boy break bring brown build business but buy by call camera can car card care case cat cause chair change
check child choose church circle city class clean clear close cloud coat cold color come common company complete
computer condition consider contain control cook cool copper copy corn correct cost could count country course cover
create cross cry current cut data day december deep describe design detail did different dinner direct do doctor
does dog door down draw dream dress drink drive dry during each early earth east eat edge effect egg eight either
el electric else end energy engine enough equal even evening event every example except expect eye face fact fall
family far farm fast father feel few field fig file fill final find fine finger finish fire first fish five floor
flow flower fly follow food foot for force forest form forward four free fresh friend from front full game garden
gave general get girl give glad go gold good government great green ground group grow guess had half hand happen
happy hard has hat have he head hear heart heat heavy help her here high hill his history hold home horse hour
house how however huge human hundred ice idea if image important in inch include increase index inside interest
internationalization into iron is island it januar job join just keep kind king know lady lake land language large
last late law lead learn leave left less letter level life light like line liquid list listen little live long look
lost lot love low machine made mail main make man management many map mark market material matter may me mean
measure meet metal method middle might mile milk million mind minute miss modern money month moon more morning most
mother mountain move much music must name nation natural near need never new next night no noise north not note
nothing notice now number object ocean of off office often oil old on once one only open or orange order other our
out over own page paint paper part party pass passage path pattern pay people perhaps person picture piece place
plan plane plant play point policy poor port position possible power practice present press price print private
problem produce product public pull purple push put quality question quick quiet race rain ran reach read ready
real reason receive record red region remember repeat report request require responsibilities rest result rich ride
right ring river road rock room round rule run said same sand saw say school science sea search season seat second
secret see seem select send sense sentence serve service set seven several shall shape she ship shop short should
show side sign silver simple since sing sister sit six size skin sky sleep slow small smile snow so soil soldier
some song soon sound south space speak special spring square stand staple star start state station stay step still
stone stop store story street strong student study such summer sun supply sure surface system table tail take talk
teach team tell ten term test than thank that the their them then there these they thing think this those thought
thousand three through time to today together token too top total touch town trade train travel tree trip true try
turn two type under unit until up use user usual valley value very view village visit voice wait walk wall want war
warm was wash watch water way we wear weather week weight well went were west what wheel when where which while
white who whole why wide wild will wind window winter wish with woman wonder wood word work world would write year
yellow yes yet you young zebra zone casa perro ciudad trabajo gobierno información también después mientras
artículo según año niño corazón lluvia straße über haus wasser gesellschaft entwicklung zusammenarbeit für größe
schön mädchen fenster tür être français élève première après gouvernement développement forêt garçon lumière
""".split()
HINTS = "password passwd pwd passphrase secret token api_key apikey api-key auth bearer client_secret access_key private_key credential login signing_key db_password secret_key".split()
SCHEMES = "postgres mysql mongodb redis amqp ftp https".split()


class Lines:
    """A source of lines: next() gives a text and where its secrets are."""

    def __init__(self, seed: int):
        self._rng = np.random.default_rng(seed)
        self.lower = "abcdefghijklmnopqrstuvwxyz"
        self.letters, self.digits = self.lower.upper() + self.lower, "0123456789"

    def pick(self, *of):
        return of[self._rng.integers(len(of))]

    def chance(self, p: float) -> bool:
        return bool(self._rng.random() < p)

    def some(self, alphabet: str, a: int, b: int) -> str:
        return "".join(self._rng.choice(list(alphabet), self._rng.integers(a, b + 1)))

    def word(self) -> str:
        """A word as texts have it: real, invented, or a heap of letters as odd languages and typists make them."""
        x = self._rng.random()
        if x < 0.45:
            w = self.pick(*WORDS)
        elif x < 0.75:
            w = "".join(
                self.pick("", "b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "tr", "pr", "ch", "sh", "th")
                + self.pick("a", "e", "i", "o", "u", "ea", "ou", "io", "é", "ö")
                + self.pick("", "", "n", "r", "s", "t", "l", "m", "nd", "st", "ng", "ck", "rt", "ght", "nstr", "rsch", "tz")
                for _ in range(self._rng.integers(1, 5))
            )
        else:
            w = "".join(self.pick("th", "nd", "st", "er", "re", "on", "an", "wh", "sh", "nt", "ti", "ing", "ed", "ou", "en", "ly", "pf", "che", "ich", "ó", "ñ", "qu", "und", "schtz", "ber", "lich", "pfl") for _ in range(self._rng.integers(1, 8)))
        return self.pick(w, w, w, w, w.capitalize(), w.upper() if len(w) < 12 else w)

    def sentence(self, n: int) -> str:
        return " ".join(self.word() + self.pick("", "", "", "", ",", ".", ";", ":", "!", "###", "$$$") for _ in range(n))

    def strong(self) -> str:
        """A value that looks like a secret anywhere."""
        both = self.letters + self.digits
        return self.pick(
            lambda: self.some(both, 18, 44),
            lambda: self.some(both, 18, 44),
            lambda: self.some(self.lower + self.digits, 20, 40),
            lambda: self.some(self.lower.upper() + self.digits, 18, 32),
            lambda: self.some("0123456789abcdef", 24, 64),
            lambda: self.some("0123456789ABCDEF", 32, 64),
            lambda: self.some(both, 9, 20) + self.pick("-", "_", "+", "/") + self.some(both, 9, 24),
            lambda: "/".join(self.some(both, 6, 18) for _ in range(3)),
            lambda: ".".join(["eyJ" + self.some(both, 14, 30), *(self.some(both, 16, 40) for _ in range(2))]),
            lambda: self.pick("sk", "pk", "ghp", "xoxb", "glpat", "key", "rk_live") + self.pick("_", "-") + self.some(both, 18, 36),
            lambda: self.some(both, 30, 60) + self.pick("=", "=="),
            lambda: self.some(self.letters, 24, 40),
        )()

    def weak(self) -> str:
        """A value that only its surroundings give away."""
        both = self.letters + self.digits

        def phrase() -> str:
            return "".join(w for w in (self.pick(*WORDS) for _ in range(self._rng.integers(4, 7))) if w.isascii() and len(w) > 2) or "openseamoonrock"

        return self.pick(
            phrase,
            phrase,
            phrase,
            lambda: "-".join(self.pick(*WORDS) for _ in range(self._rng.integers(3, 5))),
            lambda: self.pick(*WORDS) + self.some(self.digits, 1, 4) + self.pick("!", "#", "$", "", "!x", "@1"),
            lambda: self.pick(*WORDS).capitalize() + self.some(self.digits, 2, 4) + self.pick("!", "#", "$", "", "!x"),
            lambda: self.pick("S3cr", "P4ss", "Adm1n", "R00t", "h4ck", "Qw3rty") + self.some(both, 2, 8) + self.pick("", "!", "$"),
            lambda: self.some(both, 9, 16),
            lambda: self.some(self.letters, 14, 24),
            lambda: self.some(self.digits, 12, 24),
            lambda: self.some(self.lower + self.digits, 10, 16),
            lambda: "-".join(self.some(self.lower.upper() + self.digits, 5, 5) for _ in range(self._rng.integers(3, 6))),
            lambda: self.some(both, 5, 10) + "/" + self.some(both, 5, 10) + "/" + self.some(both, 12, 20),
        )()

    def plain(self) -> str:
        """A word with signs or digits that is no secret."""
        low, dig, both = self.lower, self.digits, self.letters + self.digits
        name = lambda: self.pick(*WORDS)
        return self.pick(
            lambda: f"{self.pick('http', 'https')}://{name()}.{self.pick('com', 'org', 'net')}/{name()}/{self.some(dig, 2, 8)}",
            lambda: f"https://{self.pick('www.', '')}{name()}.com/{self.pick('watch?v=', 'embed/', 'v/', 'p/', 'reel/', 's/')}{self.some(both + '-_', 9, 12)}",
            lambda: f"https://{name()}.com/{name()}?page={self.some(dig, 1, 3)}&ref={name()}&id={self.some(dig, 4, 9)}",
            lambda: f"https://{name()}.org/{'-'.join(name() for _ in range(5))}.html",
            lambda: f"{name()}.{self.some(dig, 1, 4)}@{name()}{self.some(dig, 0, 2)}.{self.pick('com', 'org')}",
            lambda: f"20{self.some(dig, 2, 2)}-0{self.some('123456789', 1, 1)}-1{self.some(dig, 1, 1)}{self.pick('', 'T10:00:00Z')}",
            lambda: f"v{self.some(dig, 1, 1)}.{self.some(dig, 1, 2)}.{self.some(dig, 1, 2)}{self.pick('', '-rc1', '-beta2')}",
            lambda: self.some(dig, 1, 10),
            lambda: self.some(dig, 15, 16),
            lambda: f"+{self.some(dig, 2, 3)}-{self.some(dig, 3, 3)}-{self.some(dig, 4, 8)}",
            lambda: f"{self.some(dig, 3, 3)}-{self.some(dig, 4, 4)}",
            lambda: f"({self.some(dig, 3, 3)})",
            lambda: name().capitalize() + self.some(dig, 1, 4),
            lambda: name() + self.some(dig, 1, 2) + name() + self.some(dig, 1, 3),
            lambda: "".join(name() + self.some(dig, 1, 3) for _ in range(self._rng.integers(2, 4))),
            lambda: self.pick("", "(") + name() + self.some(dig, 1, 2) + name() + self.some(dig, 1, 2) + self.pick(".", ",", ")"),
            lambda: f"{self.pick('IMG', 'DSC', 'file', 'scan', 'report')}_{self.some(dig, 4, 8)}.{self.pick('jpg', 'png', 'pdf', 'csv')}",
            lambda: f"{self.some(low.upper(), 2, 3)}-{self.some(dig, 3, 6)}",
            lambda: self.some(dig, 1, 4) + self.pick("GB", "km", "px", "th", "MHz", "kg"),
            lambda: f"#{self.some('0123456789abcdef', 6, 6)}",
            lambda: f"{name()}-{name()}-{self.some(dig, 1, 4)}",
            lambda: f"{name()}={self.pick(name(), self.some(dig, 1, 5), 'true')}",
            lambda: ".".join(self.some(dig, 1, 3) for _ in range(4)),
            lambda: name() + "".join(w.capitalize() for w in (name(), name(), name())) + self.pick("", "()", ";", "("),
            lambda: "_".join(name() for _ in range(self._rng.integers(2, 5))) + self.pick("", "()", ".py", " ="),
            lambda: "".join(name().capitalize() for _ in range(self._rng.integers(2, 4))) + self.pick("", "Exception", "Factory", "2"),
            lambda: "/" + "/".join(name() for _ in range(self._rng.integers(2, 5))) + self.pick("", ".txt"),
            lambda: f"{name()}/{name()}-{name()}/{self.some(dig, 1, 3)}",
            lambda: self.pick("-", "=", "_", "*", "#", ".", "|") * int(self._rng.integers(1, 30)),
            lambda: self.pick('"', "(", "'", "<", "**") + name() + self.pick('"', ")", "'", ">", "**", ","),
            lambda: f"ISBN-{self.some(dig, 13, 13)}",
            lambda: "-".join(self.some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
            lambda: self.pick("H2SO4", "MP3", "x86_64", "utf-8", "3D", "COVID-19", "B2B", "ISO-8859-1", "Web2.0", "i18n", "k8s", "p95", "sha256", "base64"),
        )()

    def _around(self, before: str, value: str, after: str) -> tuple[str, list[tuple[int, int]]]:
        lead = self.sentence(int(self._rng.integers(0, 5)))
        lead = f"{lead} " if lead else ""
        tail = self.pick("", " " + self.sentence(int(self._rng.integers(1, 5))))
        at = len(lead) + len(before)
        return lead + before + value + after + tail, [(at, at + len(value))]

    def secret(self) -> tuple[str, list[tuple[int, int]]]:
        hint, q = self.pick(*HINTS), self.pick("", "", '"', "'")
        hint = self.pick(hint, hint, hint.upper(), hint.replace("_", " "), hint.capitalize(), f"{self.pick(*WORDS)}_{hint}")
        value = self.weak() if self.chance(0.55) else self.strong()
        end = self.pick("", "", ",", ";", ".")
        return self.pick(
            lambda: self._around(hint.replace(" ", "_") + self.pick("=", ":", "=", "'=>'") + q, value, q + end),
            lambda: self._around(f"{hint}{self.pick(': ', ' = ', ' := ', '= ', ' => ', ': ')}{q}", value, q + end),
            lambda: self._around(f'"{hint}": "', value, '"' + self.pick("", ",", "}")),
            lambda: self._around(f"{hint} {self.pick('is', 'is', 'was', 'is now', 'ist', 'es', 'est', 'lautet', 'set to')} {q}", value, q + end),
            lambda: self._around(f"{self.pick('', 'my ', 'the ', 'our ')}{hint} {self.pick('is', 'is', 'was', '=')} {q}", self.weak(), q + self.pick("", "", ".", " please")),
            lambda: self._around(f"{hint} ", value if self.chance(0.3) else self.strong(), end),
            lambda: self._around(f"{self.pick('Authorization: ', '')}{self.pick('Bearer', 'bearer', 'Token')} ", self.strong(), end),
            lambda: self._around(f"{self.pick(*SCHEMES)}://{self.pick(*WORDS)}:", value.replace("/", "x").replace("@", "a"), f"@{self.pick(*WORDS)}.{self.pick('com', 'local', 'net')}{self.pick('', ':5432', '/db', ':27017/main')}"),
            lambda: self._around(f"https://{self.pick(*WORDS)}.com/{self.pick(*WORDS)}?{self.pick('token', 'api_key', 'auth', 'signature', 'access_token')}=", self.strong().split("=")[0].split("/")[0] + self.some(self.letters + self.digits, 8, 12), self.pick("", "&x=1")),
            lambda: self._around("", self.strong(), f" is {self.pick('my', 'the', 'our', 'your')} {hint}"),
            lambda: self._around(self.pick("", "", '"', "(", "id "), self.strong(), self.pick("", "", '"', ")", ".")),
        )()

    def ordinary(self) -> tuple[str, list[tuple[int, int]]]:
        hint = self.pick(*HINTS).replace("_", self.pick("_", " "))
        hint = self.pick(hint, hint.capitalize(), f"{hint}s")
        return (
            self.pick(
                lambda: self.sentence(int(self._rng.integers(1, 10))),
                lambda: self.sentence(int(self._rng.integers(1, 10))),
                lambda: f"{self.sentence(2)} {self.plain()} {self.sentence(2)}",
                lambda: " ".join(self.plain() for _ in range(4)),
                lambda: f"{self.sentence(2)} {hint} {self.pick('', '', 'is ', 'was ', ': ', 'for ')}{self.sentence(3)}",
                lambda: f"{self.sentence(1)} {hint}{self.pick(':', '=', ' =')} {self.word().lower()} {self.sentence(2)}",
                lambda: f"the {hint} {self.pick('required', 'expired', 'reset page', 'manager', 'of thanks', 'garden', 'field', 'is invalid', 'is required', 'must change', 'was updated', 'has expired')}",
                lambda: f"{hint} {self.pick('see', 'of', 'and', 'for', 'must', 'on', 'is')} {self.plain()} {self.sentence(2)}",
                lambda: f"{self.pick(*WORDS)}.{self.pick('token', 'secret', 'password', 'auth')}{self.pick('()', 's', '.value', '_id', '')} {self.sentence(2)}",
                lambda: f"{hint}{self.pick('=', ': ', ' = ')}{self.pick('None', 'null', 'true', 'get_password()', 'os.environ', '<hidden>', '****', '${SECRET}', 'getToken(user)')} {self.sentence(2)}",
            )(),
            [],
        )

    def some_lines(self, n: int, share: float = 0.4) -> list[tuple[str, list[tuple[int, int]]]]:
        """Lines, the share of which has a secret; some are dressed as parts of code."""
        out = []
        for _ in range(n):
            text, spans = self.secret() if self.chance(share) else self.ordinary()
            if self.chance(0.25):
                head = self.pick("x = 1;\n", "{\n", "host: local\nport: 80\nuser: me\n", "a=1\nb=2\n", "# config\n")
                text, spans = head + text, [(a + len(head), b + len(head)) for a, b in spans]
            out.append((text, spans))
        return out
