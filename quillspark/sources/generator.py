"""Made requests with their contracts 1.1: a seeded grammar, one row a number, the same on any cluster.

A scenario is a thing and facts that fit it; each fact brings its words and its predicate, so a text and its
contract say the same by construction. Blocks are small grammars that contrast one difference in meaning.
Rows are made from (seed, number) alone, so partitions and retries don't matter; the guard of contracts 1.1
accepts every row of a complete request.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.requests import BUCKETS
from quillspark.functions.rowwise import dumped

CITIES = ["Roma", "Milano", "Torino", "Napoli", "Bologna", "Genova", "Verona"]
DAYS = ["sabato", "domenica", "venerdi", "stasera", "dopodomani"]
WORDS = {2: "due", 3: "tre", 4: "quattro", 5: "cinque", 6: "sei"}


@dataclass(frozen=True)
class Fact:
    """What is wanted: its words, its predicate and the bucket that the predicate belongs to."""

    words: str
    predicate: dict
    bucket: str = "constraints"

    @property
    def property(self) -> str:
        return self.predicate["property"]

    def softly(self) -> Fact:
        return Fact(f"possibilmente {self.words}", self.predicate, "preferences")


@dataclass(frozen=True)
class Thing:
    name: str
    kind: str
    feminine: bool
    facts: tuple[str, ...]


THINGS = [
    Thing("pizza", "food", True, ("price", "without", "place", "day", "with")),
    Thing("panino", "food", False, ("price", "without", "place", "with")),
    Thing("hotel", "accommodation", False, ("price", "stars", "place", "guests", "amenity", "near", "day")),
    Thing("appartamento", "real_estate", False, ("price", "place", "rooms", "amenity")),
    Thing("portatile", "electronics", False, ("price", "ram", "colour", "state")),
    Thing("bicicletta", "product", True, ("price", "colour", "state", "place")),
    Thing("corso", "education", False, ("price", "length", "place", "language")),
    Thing("ristorante", "place", False, ("stars", "place", "guests", "hour", "near")),
]


def agreed(adjective: str, feminine: bool) -> str:
    """An adjective in the gender of its noun."""
    return adjective[:-1] + "a" if feminine and adjective.endswith("o") else adjective


def article(noun: str, feminine: bool) -> str:
    if feminine:
        return "un'" if noun[0] in "aeiou" else "una "
    return "uno " if noun[0] == "z" or (noun[0] == "s" and noun[1] not in "aeiou") else "un "


def predicate(name: str, operator: str, value, **more) -> dict:
    return {"property": name, "operator": operator, "value": value, **more}


def _price(r: random.Random, t: Thing) -> Fact:
    n = r.choice([10, 25, 80, 300, 750, 1200])
    words, op = r.choice([("sotto i {} euro", "lt"), ("al massimo {} euro", "lte"), ("almeno {} euro", "gte"), ("{} euro massimo", "lte")])
    return Fact(words.format(n), predicate("price", op, n, currency="EUR"))


def _one_of(name: str, values: list[str], words: str = "{}", operator: str = "eq", bucket: str = "attributes") -> Callable[[random.Random, Thing], Fact]:
    def make(r: random.Random, t: Thing) -> Fact:
        value = agreed(r.choice(values), t.feminine) if name in ("color", "condition") else r.choice(values)
        return Fact(words.format(value), predicate(name, operator, value), bucket)

    return make


def _counted(name: str, words: str, most: int, bucket: str = "attributes", **more) -> Callable[[random.Random, Thing], Fact]:
    def make(r: random.Random, t: Thing) -> Fact:
        n = r.randint(2, most)
        return Fact(words.format(WORDS.get(n, n) if r.random() < 0.3 else n), predicate(name, "eq", n, **more), bucket)

    return make


def _hour(r: random.Random, t: Thing) -> Fact:
    n = r.randint(12, 22)
    return Fact(f"alle {n}", predicate("time", "eq", f"{n}:00"))


def _near(r: random.Random, t: Thing) -> Fact:
    n = r.randint(2, 30)
    return Fact(f"entro {n} km", predicate("distance", "lte", n, unit="km"))


def _memory(r: random.Random, t: Thing) -> Fact:
    n = r.choice([8, 16, 32])
    return Fact(f"con {n} GB di ram", predicate("ram", "eq", n, unit="GB"), "attributes")


#: Makers of facts by name.
MAKERS: dict[str, Callable[[random.Random, Thing], Fact]] = {
    "price": _price, "hour": _hour, "near": _near, "ram": _memory,
    "without": _one_of("ingredient", ["cipolla", "aglio", "glutine", "funghi"], "senza {}", "excludes", "constraints"),
    "with": _one_of("ingredient", ["bufala", "rucola", "tonno"], "con {}", "contains"),
    "place": _one_of("location", CITIES, "a {}", bucket="constraints"), "day": _one_of("date", DAYS, bucket="constraints"),
    "colour": _one_of("color", ["rosso", "nero", "bianco", "giallo"]), "state": _one_of("condition", ["nuovo", "usato"]),
    "amenity": _one_of("amenity", ["piscina", "palestra", "terrazza"], "con {}", "contains"), "language": _one_of("language", ["inglese", "tedesco"], "di {}"),
    "stars": _counted("stars", "a {} stelle", 5), "guests": _counted("guests", "per {} persone", 6), "rooms": _counted("rooms", "con {} camere", 5),
    "length": _counted("duration", "di {} mesi", 6, unit="months"),
}


@dataclass
class Request:
    """A text and its contract; rows of a family are variants of one request."""

    text: str
    contract: dict
    block: str
    family: str = ""
    tags: list[str] = field(default_factory=list)


def contract(*goals: dict, reason: str | None = None, missing: list[str] = ()) -> dict:
    return {"schema_version": "1.1", "goals": list(goals), "clarification": {"required": reason is not None, "reason": reason, "missing_fields": list(missing)}}


def goal(name: str, kind: str | None, facts: list[Fact], said: str = "trova", action: str = "find", **more) -> dict:
    return {"action": action, "raw_action": said, "target": {"name": name, "type": kind, "raw": name}, **{b: [f.predicate for f in facts if f.bucket == b] for b in BUCKETS}, **more}


# ---------------------------------------------------------------- scenarios and their wording


def scenario(r: random.Random, most: int = 3) -> tuple[Thing, list[Fact]]:
    """A thing and one to `most` facts of different properties."""
    t = r.choice(THINGS)
    facts: dict[str, Fact] = {}
    for name in r.sample(t.facts, r.randint(1, min(most, len(t.facts)))):
        f = MAKERS[name](r, t)
        facts.setdefault(f.property, f)
    return t, list(facts.values())


STYLES = ["plain", "polite", "greeting", "comma", "facts_first", "question", "noun_only", "telegraph"]


def worded(t: Thing, facts: list[Fact], style: str) -> tuple[str, str]:
    """(text, words of the action) of a scenario in one of eight styles."""
    thing, rest = f"{article(t.name, t.feminine)}{t.name}", [f.words for f in facts]
    tail = " ".join(rest)
    if style == "polite":
        return f"Per favore trova {thing} {tail}, grazie", "trova"
    if style == "greeting":
        return f"Ciao, cerca {thing} {tail}", "cerca"
    if style == "comma":
        return f"Trova {thing}, {', '.join(rest)}", "trova"
    if style == "facts_first":
        return f"Cerco, {', '.join(rest)}, {thing}", "cerco"
    if style == "question":
        return f"Mi trovi {thing} {tail}?", "trovi"
    if style == "noun_only":
        return f"{thing.capitalize()} {tail}", "(implicito)"
    if style == "telegraph":
        return telegraphed(f"Trova {thing} {tail}"), "trova"
    return f"Trova {thing} {tail}", "trova"


def telegraphed(text: str) -> str:
    """Without the articles, as in a short message."""
    return " ".join(w for w in text.replace("un'", "").split() if w not in ("un", "una", "uno"))


def mistyped(text: str, r: random.Random) -> str:
    """Two neighbouring letters of a lower-case word of six or more are swapped."""
    words = text.split(" ")
    long = [i for i, w in enumerate(words) if len(w) >= 6 and w.isalpha() and w.islower()]
    if long:
        i = r.choice(long)
        k = r.randrange(1, len(words[i]) - 2)
        words[i] = words[i][:k] + words[i][k + 1] + words[i][k] + words[i][k + 2 :]
    return " ".join(words)


def _plain(r: random.Random) -> Request:
    t, facts = scenario(r)
    text, said = worded(t, facts, r.choice(STYLES))
    return Request(text, contract(goal(t.name, t.kind, facts, said)), "plain")


# ---------------------------------------------------------------- blocks of contrast


def _block(name: str, t: Thing, facts: list[Fact], text: str | None = None, said: str = "trova", **more) -> Request:
    text = text or f"Trova {article(t.name, t.feminine)}{t.name} {' '.join(f.words for f in facts)}"
    return Request(text, contract(goal(t.name, t.kind, facts, said, **more)), name)


def _gate(r: random.Random) -> Request:
    t, n = r.choice(THINGS), r.choice([10, 50, 400])
    then, verb = r.choice([("buy", "compra"), ("book", "prenota")])
    when = predicate("price", "lt", n, currency="EUR")
    return _block("gate", t, [], f"Trova {article(t.name, t.feminine)}{t.name} e se costa meno di {n} euro {verb}, altrimenti avvisami", gate={"when": when, "then": then, "otherwise": "notify"})


def _ambiguous(r: random.Random) -> Request:
    text, missing = r.choice([("Vorrei qualcosa di bello", "target"), ("Mi serve una cosa per domani", "target"), ("Fai tu come al solito", "action"), ("Quello di prima", "target")])
    empty = {"action": "find", "raw_action": "(implicito)", "target": {"name": "unknown", "type": None, "raw": text}, **{b: [] for b in BUCKETS}}
    return Request(text, contract(empty, reason="target_missing" if missing == "target" else "action_ambiguous", missing=[missing]), "ambiguous")


def _number_role(r: random.Random) -> Request:
    n, t = r.randint(13, 22), r.choice([x for x in THINGS if x.name in ("hotel", "ristorante")])
    fact = r.choice([Fact(f"alle {n}", predicate("time", "eq", f"{n}:00")), Fact(f"per {n} persone", predicate("guests", "eq", n), "attributes"), Fact(f"da {n} euro", predicate("price", "eq", n, currency="EUR")), Fact(f"a {n} km", predicate("distance", "eq", n, unit="km"))])
    return _block("number_role", t, [fact])


def _comparative(r: random.Random) -> Request:
    t, n = r.choice(THINGS), r.choice([20, 90, 500])
    words, op = r.choice([("a {} euro", "eq"), ("sotto i {} euro", "lt"), ("al massimo {} euro", "lte"), ("oltre {} euro", "gt"), ("almeno {} euro", "gte")])
    return _block("comparative", t, [Fact(words.format(n), predicate("price", op, n, currency="EUR"))])


def _two_numbers(r: random.Random) -> Request:
    a, b = r.choice([60, 90, 150]), r.randint(2, 5)
    facts = [Fact(f"sotto i {a} euro", predicate("price", "lt", a, currency="EUR")), Fact(f"con almeno {b} stelle", predicate("stars", "gte", b))]
    r.shuffle(facts)
    return _block("two_numbers", THINGS[2], facts)


def _shared(r: random.Random) -> Request:
    """Two things with one price ceiling each."""
    a, b = r.sample([t for t in THINGS if "price" in t.facts], 2)
    n = r.choice([30, 70, 900])
    fact = Fact("", predicate("price", "lt", n, currency="EUR"))
    text = f"Trova {article(a.name, a.feminine)}{a.name} e {article(b.name, b.feminine)}{b.name}, sotto i {n} euro"
    return Request(text, contract(goal(a.name, a.kind, [fact]), goal(b.name, b.kind, [fact])), "shared")


def _negated(r: random.Random) -> Request:
    t, (a, b) = THINGS[0], r.sample(["cipolla", "aglio", "rucola", "tonno"], 2)
    facts = [Fact(f"con {a}", predicate("ingredient", "contains", a), "attributes"), Fact(f"senza {b}", predicate("ingredient", "excludes", b))]
    return _block("negated", t, facts)


def _force(r: random.Random) -> Request:
    """The same wish, hard or soft."""
    t = r.choice([x for x in THINGS if "colour" in x.facts])
    f = MAKERS["colour"](r, t)
    return _block("force", t, [f.softly() if r.random() < 0.5 else f])


def _listed(r: random.Random) -> Request:
    t = r.choice([x for x in THINGS if "place" in x.facts])
    a, b = r.sample(CITIES, 2)
    return _block("listed", t, [Fact(f"a {a} o {b}", predicate("location", "in", f"{a}|{b}"))])


def _date_or_limit(r: random.Random) -> Request:
    t, n = THINGS[2], r.choice([80, 120])
    fact = r.choice([Fact(f"per {(d := r.choice(DAYS))}", predicate("date", "eq", d)), Fact(f"al massimo {n} euro", predicate("price", "lte", n, currency="EUR"))])
    return _block("date_or_limit", t, [fact])


def _quantity(r: random.Random) -> Request:
    n = r.randint(2, 6)
    said = WORDS[n] if r.random() < 0.5 else n
    return Request(f"Trova {said} biglietti", contract(goal("biglietti", "ticket", [Fact("", predicate("quantity", "eq", n), "attributes")])), "quantity")


def _availability(r: random.Random) -> Request:
    t, d = r.choice([THINGS[2], THINGS[7]]), r.choice(DAYS)
    return _block("availability", t, [Fact(f"disponibile {d}", predicate("availability", "eq", d))])


def _specific(r: random.Random) -> Request:
    """A general or a specific name for one thing."""
    t = r.choice([THINGS[0], THINGS[4]])
    name = {"pizza": ["pizza", "pizza margherita"], "portatile": ["portatile", "portatile gaming"]}[t.name][r.randint(0, 1)]
    return _block("specific", Thing(name, t.kind, t.feminine, t.facts), [MAKERS["price"](r, t)])


def _english(r: random.Random) -> Request:
    name, kind = r.choice([("hotel", "accommodation"), ("laptop", "electronics"), ("pizza", "food")])
    n, city = r.choice([20, 90, 700]), r.choice(["Rome", "Milan", "Turin"])
    words, op = r.choice([("under", "lt"), ("at most", "lte"), ("over", "gt")])
    facts = [Fact("", predicate("price", op, n, currency="EUR")), Fact("", predicate("location", "eq", city))]
    return Request(f"Find a {name} {words} {n} euro in {city}", contract(goal(name, kind, facts, "find")), "english")


def _first_style(r: random.Random) -> Request:
    """The oldest wording: a verb, a thing and its facts joined by and."""
    t, facts = scenario(r)
    return Request(f"Cercami {article(t.name, t.feminine)}{t.name} {' e '.join(f.words for f in facts)}", contract(goal(t.name, t.kind, facts, "cercami")), "first_style")


BLOCKS: dict[str, Callable[[random.Random], Request]] = {
    "plain": _plain, "gate": _gate, "ambiguous": _ambiguous, "number_role": _number_role, "comparative": _comparative, "two_numbers": _two_numbers,
    "shared": _shared, "negated": _negated, "force": _force, "listed": _listed, "date_or_limit": _date_or_limit, "quantity": _quantity,
    "availability": _availability, "specific": _specific, "english": _english, "first_style": _first_style,
}


def enriched(x: Request, r: random.Random) -> Request:
    """A block's request with one more fact that fits: a day, where there is none yet."""
    g = x.contract["goals"]
    held = {p["property"] for b in BUCKETS for p in g[0][b]}
    if x.block in ("ambiguous", "gate", "shared", "english", "quantity") or {"date", "availability"} & held:
        return x
    f = MAKERS["day"](r, THINGS[0])
    made = {**g[0], "constraints": [*g[0]["constraints"], f.predicate]}
    return Request(f"{x.text.rstrip('?')} {f.words}", contract(made), x.block, x.family)


SWAPS = [("sotto i", "lt", "oltre", "gt"), ("al massimo", "lte", "almeno", "gte"), ("oltre", "gt", "sotto i", "lt"), ("almeno", "gte", "al massimo", "lte"), ("senza", "excludes", "con", "contains")]


def contrasts(x: Request) -> Iterator[Request]:
    """Up to two variants of a request in which one word, and with it one operator, is turned round."""
    made = 0
    if len(x.contract["goals"]) != 1:
        return
    g = x.contract["goals"][0]
    for words, op, other, turned in SWAPS:
        hits = [p for p in g["constraints"] if p["operator"] == op]
        if made == 2 or len(hits) != 1 or x.text.count(f"{words} ") != 1:
            continue
        p = {**hits[0], "operator": turned}
        bucket = "attributes" if turned == "contains" else "constraints"
        rest = {**g, "constraints": [q for q in g["constraints"] if q is not hits[0]]}
        made += 1
        yield Request(x.text.replace(f"{words} ", f"{other} "), contract({**rest, bucket: [*rest[bucket], p]}), x.block, x.family, ["contrast"])


def made(seed: int, i: int, shares: dict[str, float] | None = None) -> list[Request]:
    """The requests of a number: one of a block drawn by the shares, and its contrasts."""
    r = random.Random(f"{seed}/{i}")
    names = list(shares or BLOCKS)
    x = BLOCKS[r.choices(names, [(shares or {}).get(n, 1.0) for n in names])[0]](r)
    x = enriched(x, r) if r.random() < 0.3 else x
    x.family = f"f{i}"
    return [x, *contrasts(x)]


def corpus(spark: SparkSession, n: int, *, seed: int = 0, shares: dict[str, float] | None = None, partitions: int | None = None) -> DataFrame:
    """(id, family, block, text, contract, tags) of n families."""
    schema = "id string, family string, block string, text string, contract string, tags array<string>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(f"{x.family}.{k}", x.family, x.block, x.text, dumped(x.contract), x.tags) for i in batch.column(0).to_pylist() for k, x in enumerate(made(seed, i, shares))]
            kinds = [*[pa.string()] * 5, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(rows, schema)


# ---------------------------------------------------------------- dialogue


def dialogue(seed: int, i: int) -> list[dict]:
    """Turns (text, decision) of a made conversation: talk, an opening that lacks a place, the answer, a correction, the end."""
    r = random.Random(f"dialogue/{seed}/{i}")
    decide = lambda mode, operation, updates=(), **more: {"protocol_version": "conversation-v1", "mode": mode, "operation": operation, "updates": list(updates), **more}
    kind, day = r.choice([("ristorante", "place"), ("hotel", "accommodation")]), r.choice(["oggi", "domani", "dopodomani"])
    a, b = r.sample(CITIES, 2)
    turns = [{"text": "Che significa prenotazione?", "decision": decide("QUESTION", "NO_GOAL")}] if r.random() < 0.4 else []
    turns.append({"text": f"Cerca un {kind[0]} per {day}", "decision": decide("ACTIONABLE_GOAL", "OPEN_DRAFT", [{"slot": "temporal.search_date", "value": day}], action="find", target={"name": kind[0], "type": kind[1]})})
    turns.append({"text": f"A {a}", "decision": decide("ANSWER_TO_CLARIFICATION", "UPDATE_DRAFT", [{"slot": "fact.location", "value": a}])})
    if r.random() < 0.5:
        turns.append({"text": f"Anzi no, a {b}", "decision": decide("CONTINUATION", "UPDATE_DRAFT", [{"slot": "fact.location", "value": b}])})
    if r.random() < 0.3:
        turns.append({"text": "Lascia stare", "decision": decide("CANCELLATION", "CANCEL_DRAFT")})
    return turns
