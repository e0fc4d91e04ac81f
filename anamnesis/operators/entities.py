"""Entity resolution: an ordered fold of the mentions of each session, with aliases, speakers, pronouns, relatives and merges.

Order decides here (a later mention sees what earlier ones taught), so each session is folded by itself in a grouped map;
its state is one session's names. Iteration over alternatives is in a fixed order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Word lists.
FIRST_PERSON = set("i me my myself mine we us our ours speaker user".split()) | {"the speaker", "the user"}
PRONOUNS = set("he him his she her hers they them their theirs".split())
OWNERS = {"his", "her", "their"}
RELATIVES = set("wife husband spouse partner manager boss brother sister mother father parent son daughter child friend colleague".split())
IDENTITY = {"is", "am", "are", "was", "were", "called", "named", "known as", "also known as", "aka", "goes by", "renamed to", "name is"}
RENAMING = ("known as", "called", "named", "goes by", "renamed")
MOODS = set("happy sad angry tired hungry busy ready confused fine ok okay".split())
THINGS = {"like", "live in", "work at"}
TITLE = re.compile(r"^(?:dr|mr|mrs|ms|miss|prof|professor)\.?\s+", re.I)
QUALIFIER = re.compile(r"^(?:current|former|old|new|previous|ex)\s+")
INTRODUCTION = [re.compile(p + r"\s+([^.,;!?]+)", re.I) for p in (r"\bmy name is", r"\bi am", r"\bi'm", r"\bcall me", r"\bi go by", r"\bthis is")]


def clean(name: str | None) -> str:
    s = " ".join((name or "").split()).strip(" \t\r\n\"'`.,:;!?()[]{}")
    return re.sub(r"^(?:the|a|an)\s+", "", s, flags=re.I)


def alias_key(name: str | None) -> str:
    s = re.sub(r"'s\b", "", TITLE.sub("", clean(name).lower()))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", s).split())


def variants(name: str | None) -> list[str]:
    full = clean(name)
    bare = TITLE.sub("", full).strip()
    found = [full, bare] + ([bare.split()[-1]] if bare != full and bare else [])
    return [v for v in dict.fromkeys(found) if alias_key(v)]


def relative(label: str) -> str:
    words = QUALIFIER.sub("", clean(label).lower()).split()
    return words[-1] if words and words[-1] in RELATIVES else ""


def introduced(text: str) -> list[str]:
    """Names by which speakers introduce themselves."""
    out = []
    for pattern in INTRODUCTION:
        for m in pattern.finditer(text or ""):
            name = clean(re.split(r"\b(?:and|but|because|so|when|where|who|which|that)\b", clean(m[1]))[0])
            low = name.lower()
            if name and len(name.split()) <= 4 and low not in MOODS and not re.match(r"(?:a|an|the|from|in|at|on|with|into|for)\b|\d", low):
                out.append(name)
    return out


def owned(name: str) -> tuple[str, str] | None:
    """(owner, relative) of `my X`, `A's X` and `X of A`; the owner of a possessive is its pronoun."""
    s = clean(name)
    for pattern, order in ((r"^(my|mine|his|her|their)\s+(.+)$", (1, 2)), (r"^(.+?)['’]s\s+(.+)$", (1, 2)), (r"^(.+?)\s+of\s+(.+)$", (2, 1))):
        if (m := re.match(pattern, s, re.I)) and (kin := relative(m[order[1]])):
            return m[order[0]], kin
    return None


def refers(name: str) -> bool:
    return alias_key(name) in FIRST_PERSON | PRONOUNS or owned(name) is not None


def named(name: str) -> bool:
    return refers(name) or bool(re.match(r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor)?\.?\s*[A-Z][A-Za-z-]+", clean(name)))


@dataclass
class Session:
    """What one session knows. Entities are numbers; `to` leads from a merged one to the one it became."""

    to: list[int] = field(default_factory=list)
    display: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    alias: dict[str, int] = field(default_factory=dict)
    speakers: dict[str, int] = field(default_factory=dict)
    kin: dict[tuple[int, str], int] = field(default_factory=dict)
    last: dict[tuple[str, str], int] = field(default_factory=dict)

    def find(self, e: int) -> int:
        while self.to[e] != e:
            e = self.to[e]
        return e

    def new(self, name: str, aliases: list[str], kind: str) -> int:
        for a in aliases:
            if (e := self.alias.get(alias_key(a))) is not None:
                return self.find(e)
        e = len(self.to)
        self.to.append(e)
        self.display.append(name)
        self.kind.append(kind)
        for a in aliases:
            self.alias[alias_key(a)] = e
        return e

    def call(self, e: int, name: str, preferred: bool = False) -> int:
        """Another name of an entity; if it is another's, the two become one."""
        e = self.find(e)
        key = alias_key(name)
        if not key:
            return e
        if (other := self.alias.get(key)) is not None and self.find(other) != e:
            e = self.merge(e, self.find(other))
        self.alias[key] = e
        if preferred or alias_key(self.display[e]) in FIRST_PERSON | {"assistant"}:
            self.display[e] = clean(name)
        return e

    def merge(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.to[b] = a
            if self.kind[b] == "speaker":
                self.kind[a] = "speaker"
            self.kin = {(self.find(o), k): self.find(e) for (o, k), e in self.kin.items()}
        return a

    def speaker(self, who: str) -> int:
        if who not in self.speakers:
            self.speakers[who] = self.new(who, [], "speaker")
        return self.find(self.speakers[who])

    def resolve(self, name: str, who: str) -> int | None:
        s = clean(name)
        if not s:
            return None
        if pair := owned(s):
            owner, label = pair
            pronoun = owner.lower()
            if pronoun in ("my", "mine"):
                o = self.speaker(who)
            elif pronoun in OWNERS:
                held = self.last.get((who, "owner"))
                o = self.find(held) if held is not None and (self.find(held), label) in self.kin else self.pronoun(who)
            else:
                o = self.resolve(owner, who)
                if o is not None:
                    self.last[who, "owner"] = o
            if o is not None:
                if (o, label) not in self.kin:
                    called = f"{self.display[o]}'s {label}"
                    self.kin[o, label] = self.new(called, [called] + ([] if pronoun in OWNERS | {"my", "mine"} else [s]), "relational")
                return self.find(self.kin[o, label])
        key = alias_key(s)
        if key in FIRST_PERSON:
            return self.speaker(who)
        if key in PRONOUNS and (e := self.pronoun(who)) is not None:
            return e
        for v in variants(s):
            if (e := self.alias.get(alias_key(v))) is not None:
                return self.find(e)
        return self.new(s, variants(s), "entity")

    def pronoun(self, who: str) -> int | None:
        e = self.last.get((who, "person"), self.last.get((who, "any")))
        return None if e is None else self.find(e)

    def mention(self, e: int, name: str, key: str, who: str, tail: bool) -> None:
        person = (self.kind[self.find(e)] in ("speaker", "relational") or named(name)) and not (tail and key in THINGS)
        if not tail or person or key not in THINGS:
            self.last[who, "any"] = e
        if person:
            self.last[who, "person"] = e

    def triple(self, head: str, rel: str, tail: str, key: str, who: str) -> tuple[int, int] | None:
        """Both ends of a fact; None if the triple says that two names are one (they are merged)."""
        words = " ".join((rel or "").lower().split())
        renamed = any(cue in words for cue in RENAMING)
        h, t = self.resolve(head, who), self.resolve(tail, who)
        if h is None or t is None:
            return None
        if renamed or (words in IDENTITY and named(head) and named(tail)):
            e = self.merge(h, t)
            for name, last in ((head, False), (tail, True)):
                if not refers(name):
                    e = self.call(e, name, last and named(name))
            self.mention(e, tail, key, who, True)
            return None
        self.mention(h, head, key, who, False)
        self.mention(t, tail, key, who, True)
        return h, t


def resolved(triples: DataFrame) -> DataFrame:
    """(session, seq, head_id, tail_id, head_name, tail_name) of the facts; ids as they were when the triple came.

    triples: session, seq, speaker, text (null but for a turn's first triple), head, relation, key, tail."""

    def fold(key, frame):
        import pandas as pd

        s, rows = Session(), []
        text = lambda x: x if isinstance(x, str) else ""
        for r in frame.sort_values("seq").itertuples():
            who = text(r.speaker)
            for name in introduced(text(r.text)):
                for v in variants(name):
                    s.call(s.speaker(who), v, True)
            if text(r.head) and text(r.relation) and text(r.tail) and (pair := s.triple(r.head, r.relation, r.tail, text(r.key), who)):
                rows.append((key[0], r.seq, *pair, s.display[pair[0]], s.display[pair[1]]))
        return pd.DataFrame(rows, columns=["session", "seq", "head_id", "tail_id", "head_name", "tail_name"])

    kind = dict(triples.dtypes)["session"]
    return triples.groupBy("session").applyInPandas(fold, f"session {kind}, seq long, head_id long, tail_id long, head_name string, tail_name string")
