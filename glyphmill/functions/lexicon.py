"""The semantic lexicon: what a word's number is, which cluster a number lies in, and which slot and domain a cluster belongs to.

The full word list is data, given as a parameter (a JSON object or a table of word and id). STARTER holds a few words of each
cluster, enough for the tests and the registered queries.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

# Fixed values. ---------------------------------------------------------------------------------------------------------------

#: Two- and three-character tokens with their numbers.
TWO_CHAR = {
    "is": 110, "in": 111, "it": 112, "at": 113, "an": 114, "as": 115, "be": 116, "by": 117, "do": 118, "go": 119,
    "he": 120, "if": 121, "me": 122, "my": 123, "no": 124, "of": 125, "on": 126, "or": 127, "so": 128, "to": 129,
    "up": 130, "us": 131, "we": 132, "ok": 133, "db": 136, "id": 137, "ip": 138, "os": 139,
}
THREE_CHAR = {
    "the": 600, "and": 601, "for": 602, "are": 603, "but": 604, "not": 605, "you": 606, "all": 607, "can": 608, "her": 609,
    "was": 610, "one": 611, "our": 612, "out": 613, "day": 614, "get": 615, "has": 616, "him": 617, "his": 618, "how": 619,
    "let": 621, "man": 622, "new": 623, "now": 624, "old": 625, "see": 626, "two": 627, "way": 628, "did": 630, "she": 631,
    "use": 632, "may": 633, "say": 634, "any": 635, "try": 636, "run": 637, "set": 638, "var": 639, "int": 640, "str": 641,
    "def": 642, "yes": 643, "own": 644, "per": 645, "log": 646, "url": 647, "sql": 652, "csv": 653, "xml": 654,
}

#: Numbers that win where a word has several.
OVERRIDES = {
    "good": 3116, "well": 3116, "search": 3318, "find": 3316, "sort": 3555, "merge": 3580, "commit": 3578, "pipeline": 3474,
    "stream": 3408, "queue": 3403, "security": 3572, "index": 3622, "run": 3533, "build": 3532, "deploy": 3535, "test": 3537,
    "review": 3562, "schedule": 3643, "job": 3642, "plan": 4404, "process": 3631, "connect": 4411, "access": 4371, "block": 4376,
    "alert": 3497, "kafka": 3401, "redis": 3413, "cluster": 3421, "node": 3422, "record": 3624, "transaction": 5001, "fraud": 5020,
    "customer": 3755, "team": 3757, "the": 4801, "a": 4802, "an": 4803, "in": 4804, "on": 4805, "at": 4806, "to": 4807,
    "for": 4808, "of": 4809, "by": 4812, "and": 4701, "or": 4703, "not": 4725,
}

#: Clusters with their ranges of numbers, both ends included; slot; specificity rank. None: the cluster fills no slot.
CLUSTERS: list[tuple[str, int, int, int | None, int]] = [
    ("Greetings", 3000, 3050, 5, 2),
    ("Farewells", 3051, 3100, 5, 2),
    ("Positive Emotions", 3101, 3200, 3, 3),
    ("Negative Emotions", 3201, 3300, 3, 4),
    ("Questions & Inquiry", 3301, 3400, 6, 3),
    ("Tech: Messaging & Streaming", 3401, 3415, 2, 7),
    ("Tech: Container & Orchestration", 3416, 3430, 2, 7),
    ("Tech: Database & Storage", 3431, 3445, 2, 7),
    ("Tech: Networking & API", 3446, 3460, 2, 7),
    ("Tech: AI & ML", 3461, 3475, 2, 7),
    ("Tech: Cloud & Infra", 3476, 3490, 2, 6),
    ("Tech: Monitoring", 3491, 3500, 2, 6),
    ("Code: Languages", 3501, 3515, 2, 6),
    ("Code: Constructs", 3516, 3530, 2, 5),
    ("Code: Execution", 3531, 3545, 2, 5),
    ("Code: Algorithms", 3546, 3560, 2, 5),
    ("Code: Quality", 3561, 3575, 2, 5),
    ("Code: Version Control", 3576, 3600, 2, 5),
    ("Data: File Ops", 3601, 3615, 2, 4),
    ("Data: Database Ops", 3616, 3630, 2, 5),
    ("Data: Processing", 3631, 3645, 2, 4),
    ("Data: Sync & Backup", 3646, 3700, 2, 4),
    ("People: Pronouns", 3701, 3720, 0, 1),
    ("People: Tech Roles", 3721, 3735, 0, 4),
    ("People: Business Roles", 3736, 3750, 0, 3),
    ("People: General", 3751, 3800, 0, 2),
    ("Time: Units", 3801, 3815, 4, 2),
    ("Time: Relative", 3816, 3830, 4, 2),
    ("Time: Direction", 3831, 3845, 4, 2),
    ("Time: Scheduling", 3846, 3900, 4, 4),
    ("Colors", 3901, 3950, 8, 1),
    ("Numbers & Math", 3951, 4050, 8, 1),
    ("Nature & World", 4051, 4150, 8, 1),
    ("Food & Drink", 4151, 4250, 8, 1),
    ("Actions: Communication", 4251, 4270, 1, 3),
    ("Actions: Creation", 4271, 4290, 1, 3),
    ("Actions: Control", 4291, 4310, 1, 3),
    ("Actions: Movement", 4311, 4330, 1, 3),
    ("Actions: Analysis", 4331, 4350, 1, 4),
    ("Actions: Change", 4351, 4370, 1, 3),
    ("Actions: Access", 4371, 4390, 1, 5),
    ("Actions: Management", 4391, 4410, 1, 3),
    ("Actions: Connection", 4411, 4450, 1, 3),
    ("Adj: Size & Scale", 4501, 4515, 7, 2),
    ("Adj: Speed & Performance", 4516, 4530, 7, 3),
    ("Adj: Quality", 4531, 4545, 7, 3),
    ("Adj: State", 4546, 4560, 7, 4),
    ("Adj: Security & Risk", 4561, 4575, 7, 5),
    ("Adj: Technical", 4576, 4605, 7, 4),
    ("Connectors", 4701, 4800, None, 0),
    ("Prepositions", 4801, 4900, None, 0),
    ("Security Events", 4901, 4950, 9, 9),
    ("Incident Management", 4951, 5000, 9, 9),
    ("Financial Operations", 5001, 5060, 9, 9),
    ("HR Operations", 5061, 5110, 9, 9),
    ("Customer Operations", 5111, 5160, 9, 9),
    ("Miscellaneous", 5161, 9999, None, 0),
]

SLOT_NAMES = ["WHO", "ACTION", "TECH", "EMOTION", "WHEN", "SOCIAL", "INTENT", "MODIFIER", "WORLD", "DOMAIN"]

#: Beginnings and endings that hint at a cluster.
PREFIXES = {
    "cyber": "Security Events", "micro": "Tech: Container & Orchestration", "macro": "Tech: AI & ML", "meta": "Tech: AI & ML",
    "inter": "Tech: Networking & API", "intra": "Tech: Networking & API", "auto": "Adj: Technical", "multi": "Numbers & Math",
    "anti": "Negative Emotions", "mal": "Negative Emotions", "mis": "Negative Emotions", "dis": "Negative Emotions",
    "non": "Negative Emotions", "un": "Negative Emotions", "im": "Negative Emotions", "de": "Actions: Change", "re": "Actions: Change",
    "co": "People: General", "pre": "Time: Direction", "post": "Time: Direction", "over": "Adj: Size & Scale", "under": "Adj: Size & Scale",
    "semi": "Adj: Technical", "sub": "Adj: Technical", "super": "Positive Emotions", "hyper": "Positive Emotions", "ultra": "Positive Emotions",
}
SUFFIXES = {
    "ology": "Questions & Inquiry", "tion": "Actions: Management", "sion": "Actions: Management", "ment": "Actions: Management",
    "ness": "Adj: Quality", "able": "Adj: Technical", "ible": "Adj: Technical", "ical": "Adj: Technical", "ware": "Tech: Monitoring",
    "base": "Data: Database Ops", "gram": "Data: File Ops", "less": "Negative Emotions", "ful": "Positive Emotions", "ize": "Actions: Change",
    "ise": "Actions: Change", "ify": "Actions: Change", "ing": "Actions: Management", "ate": "Actions: Management", "ive": "Adj: Technical",
    "ous": "Adj: Quality", "al": "Adj: Quality", "ic": "Adj: Technical", "ly": "Adj: Quality", "ed": "Actions: Management",
    "er": "People: General", "or": "People: General", "ist": "People: General", "ian": "People: General", "age": "Data: File Ops",
    "log": "Data: File Ops", "net": "Tech: Networking & API", "tech": "Tech: Monitoring", "time": "Time: Units", "date": "Time: Scheduling",
    "day": "Time: Units",
}

#: Domains that clusters vote for.
DOMAINS = {
    "Finance": ["Financial Operations"],
    "HR": ["HR Operations"],
    "Customer": ["Customer Operations"],
    "Security": ["Security Events"],
    "Incident": ["Incident Management"],
    "DevOps": ["Tech: Messaging & Streaming", "Tech: Container & Orchestration", "Tech: Monitoring", "Tech: Cloud & Infra"],
    "Code": ["Code: Languages", "Code: Constructs", "Code: Execution", "Code: Algorithms", "Code: Quality", "Code: Version Control"],
    "Data": ["Tech: Database & Storage", "Data: File Ops", "Data: Database Ops", "Data: Processing", "Data: Sync & Backup"],
    "AI": ["Tech: AI & ML", "Tech: Networking & API"],
    "Question": ["Questions & Inquiry"],
}

#: Weights of slots 0 to 9 where both sides are of the domain.
SLOT_WEIGHTS = {
    "Finance": [1.0, 2.0, 1.5, 0.3, 1.0, 0.5, 1.0, 2.0, 1.0, 5.0],
    "HR": [3.0, 2.0, 0.5, 1.0, 2.0, 1.0, 1.0, 1.0, 0.5, 5.0],
    "Customer": [3.0, 2.5, 0.5, 2.0, 1.0, 1.0, 1.0, 1.5, 0.5, 5.0],
    "Security": [1.0, 3.0, 4.0, 1.0, 1.0, 0.3, 1.0, 4.0, 0.5, 5.0],
    "Incident": [1.0, 3.0, 4.0, 2.0, 2.0, 0.3, 1.0, 3.0, 0.5, 5.0],
    "DevOps": [0.5, 3.0, 5.0, 1.0, 1.5, 0.2, 0.5, 2.0, 1.0, 3.0],
    "Code": [1.0, 2.5, 5.0, 0.5, 1.0, 0.2, 0.5, 2.5, 1.0, 1.0],
    "Data": [0.5, 3.0, 5.0, 0.3, 1.0, 0.2, 0.5, 2.0, 1.5, 2.0],
    "AI": [1.0, 2.0, 5.0, 0.5, 1.0, 0.3, 1.0, 2.5, 1.0, 1.5],
    "Question": [1.5, 1.5, 2.0, 0.5, 1.5, 0.5, 5.0, 1.5, 1.0, 1.5],
}

#: Words left out of sentence weights, and those left out of co-occurrence besides.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in on at for with by "
    "from as or and but not this that it its their they we our you your he she all any each into during after before than then when where "
    "which who what how why both more most other some such no nor so yet now up out very too only even still also just over under per via etc get"
).split()
MORE_STOP_WORDS = "above below between through whom few either neither while although because since until whether if else got vs back well".split()

#: A part of the word list: some words of each cluster, with the numbers they have there.
STARTER = {
    "hello": 3000, "welcome": 3011, "morning": 3014, "goodbye": 3052, "later": 3053, "farewell": 3061,
    "happy": 3101, "good": 4531, "great": 3117, "love": 3131, "trust": 3152, "angry": 3216, "frustrated": 3217, "worried": 3233, "fail": 3251, "lost": 3206,
    "what": 3301, "when": 3840, "where": 3303, "which": 3304, "who": 3305, "why": 3306, "how": 3307, "find": 3316, "search": 3556, "review": 3562, "question": 3351,
    "kafka": 3401, "queue": 3553, "broker": 3404, "consumer": 3411, "producer": 3412, "redis": 3413, "kubernetes": 3416, "docker": 3417, "pod": 3419,
    "postgres": 3431, "database": 3435, "schema": 3441, "nginx": 3446, "api": 3447, "network": 3458, "model": 3461, "training": 5073, "pipeline": 3640,
    "cloud": 4076, "server": 3480, "region": 4055, "prometheus": 3491, "monitoring": 3493, "alert": 3497,
    "python": 3501, "java": 3502, "function": 3516, "class": 3517, "compile": 3531, "test": 4339, "algorithm": 3546, "hash": 3549, "refactor": 3561, "security": 3572,
    "git": 3576, "commit": 3628, "branch": 3579, "store": 3601, "read": 3604, "file": 3606, "select": 3617, "index": 3622, "record": 3624,
    "process": 3631, "batch": 3637, "backup": 3647, "json": 3655, "i": 3701, "we": 3704, "you": 3707, "they": 3711,
    "developer": 3721, "engineer": 3722, "analyst": 3728, "manager": 3736, "owner": 3740, "person": 3751, "user": 3754, "customer": 3755, "team": 3757, "client": 3756,
    "time": 3801, "hour": 3804, "day": 3805, "today": 3817, "always": 3825, "past": 3831, "before": 4821, "deadline": 3847, "meeting": 3850,
    "red": 3901, "green": 3903, "one": 3952, "total": 3969, "world": 4051, "water": 4068, "food": 4151, "coffee": 4154,
    "report": 4258, "send": 4262, "create": 4271, "design": 4276, "start": 4291, "stop": 4292, "move": 4311, "fetch": 4317, "monitor": 4332, "validate": 4337,
    "change": 4351, "fix": 4361, "resolve": 4362, "login": 4372, "authenticate": 4375, "manage": 4391, "plan": 4404, "connect": 4411, "install": 4416,
    "large": 4503, "high": 4509, "fast": 4516, "slow": 4517, "real-time": 4521, "stable": 4539, "broken": 4538, "active": 4546, "failed": 4556,
    "secure": 4561, "critical": 4563, "parallel": 4580, "internal": 4588, "and": 4701, "but": 4702, "the": 4801, "with": 4810,
    "breach": 4901, "attack": 4903, "risk": 4915, "incident": 4951, "outage": 4952, "rollback": 4967, "transaction": 5001, "payment": 5002, "account": 5008, "refund": 5129,
    "fraud": 5020, "suspicious": 5021, "hiring": 5061, "salary": 5066, "complaint": 5111, "ticket": 5112, "subscription": 5120, "delivery": 5124,
}

# -----------------------------------------------------------------------------------------------------------------------------

FALLBACK = "Miscellaneous"
GENERAL = "general"
N_SLOTS = 10
RANGES = {name: (lo, hi) for name, lo, hi, _, _ in CLUSTERS}
SLOT_OF = {name: slot for name, _, _, slot, _ in CLUSTERS if slot is not None}
RANK_OF = {name: rank for name, _, _, _, rank in CLUSTERS}
COOCCURRENCE_STOP_WORDS = [*STOP_WORDS, *MORE_STOP_WORDS]


def cluster_of(number: int | None) -> str | None:
    return next((name for name, lo, hi, _, _ in CLUSTERS if number is not None and lo <= number <= hi), None)


@dataclass(frozen=True)
class Lexicon:
    """Words with their raw numbers, in order; the order settles ties."""

    words: dict[str, int] = field(default_factory=lambda: dict(STARTER))

    @classmethod
    def from_json(cls, path: str) -> Lexicon:
        with open(path, encoding="utf-8") as f:
            return cls({str(k): int(v) for k, v in json.load(f).items()})

    @cached_property
    def lookup(self) -> dict[str, int]:
        """Every token that the encoder knows; later layers win: characters, two, three, words, overrides."""
        out: dict[str, int] = {chr(k): k for k in range(32, 127)}
        for layer in (TWO_CHAR, THREE_CHAR, self.words, OVERRIDES):
            out.update(layer)
        return out

    @cached_property
    def reverse(self) -> dict[int, str]:
        """The first token of each number."""
        out: dict[int, str] = {}
        for token, number in self.lookup.items():
            out.setdefault(number, token)
        return out

    @cached_property
    def votes(self) -> dict[str, str]:
        """The domain that a word votes for, by its raw number."""
        domain_of = {cluster: domain for domain, clusters in DOMAINS.items() for cluster in clusters}
        return {w: domain_of[c] for w, n in self.words.items() if (c := cluster_of(n)) in domain_of}

    @cached_property
    def used(self) -> dict[str, int]:
        """The largest number in use of each cluster, or one below its range."""
        numbers = [*self.words.values(), *OVERRIDES.values()]
        return {name: max((n for n in numbers if lo <= n <= hi), default=lo - 1) for name, (lo, hi) in RANGES.items()}
