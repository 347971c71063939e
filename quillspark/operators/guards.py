"""Guards of contracts 1.2 and 1.3 against the user's text: codes and a status for each contract.

A guard is a list of rules (code, condition) over the contract's arrays and the folded text. Guards form a
chain: each adds its codes, and the first that finds any decides the status. All are expressions within the
row; a table of contracts takes one pass and no exchange.

Fixed values: the patterns and word lists below are part of the language that the guards accept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import flat, plain
from quillspark.operators import validate as V
from quillspark.operators.validate import confirmed, counted, facts_of, fields_of, forbidden, has, missing_of, roles_of, times_of
from quillspark.sources.contracts import listed, number, once, parsed
from quillspark.sources.shape import structure

ACCEPT, REVIEW, REJECT = "ACCEPT", "REVIEW", "REJECT"
CLARIFY, CONFLICT, UNSUPPORTED, LACKING, POLICY, INVALID = (f"HOLD_{x}" for x in ("NEEDS_CLARIFICATION", "SEMANTIC_CONFLICT", "UNSUPPORTED_ACTION", "MISSING_REQUIRED_INFORMATION", "POLICY_MISMATCH", ""))
INVALID = "REJECT_INVALID"

# ---- fixed values: the planner's fields
FACT_FIELDS = "access amenity appointment_id author availability booking_id brand breed budget certification color condition cuisine delivery_location destination diet display distance duration feature format genre guests ingredient language location message mileage model open_now origin original_date original_time price quantity ram rating recipient room_type selection seller size specialization spiciness stars stops".split()
CONTEXT_FIELDS = "party_size has_car lodging_owned".split()
RESULT_FIELDS = ["results_count"]
ALIASES = "delivery new_date move_to action_date result_count".split()

# ---- fixed values: names
TABLE_NAMES = "tavolo ristorante pizzeria trattoria osteria".split()
FLIGHT_NAMES = "volo aereo flight".split()
PROFESSIONALS = "farmacista dentista medico idraulico elettricista fotografo giardiniere avvocato commercialista".split()
VEHICLES = "bicicletta bici scooter automobile auto furgone moto motocicletta camper".split()
TRANSPORTS = "treno pullman autobus aereo volo traghetto taxi".split()
ROUTED = {"appointment": "appointment", "medical_appointment": "appointment", "vehicle": "vehicle", "product": "product", "electronics": "product", "flower": "product", "professional_service": "professional_service", "place": "place", "accommodation": "accommodation", "transport": "transport", "reminder": "reminder", "person": "person"}
ORDINALS = {"primo": 1, "prima": 1, "secondo": 2, "seconda": 2, "terzo": 3, "terza": 3, "quarto": 4, "quarta": 4}

# ---- fixed values: patterns of the first guard
CONDITIONAL = r"\b(se|qualora|nel caso|a condizione|soltanto se)\b"
FALLBACK = r"\b(se non (?:ne )?(?:trovi|trova|ci sono)|in assenza di risultati)\b"
FOLLOW_UP = r"\bpoi\s+(?:prenota|contatta|compra|acquista|cerca|trova|ordina|noleggia|assumi|invia|avvisa)\b"
CHEAPEST = r"\b(meno caro|meno costoso|piu economico|prezzo crescente|costo crescente|spendendo il meno possibile)\b"
DONT_BOOK = r"\b(non prenotare|senza prenotare|non effettuare prenotazioni)\b"
DONT_BUY = r"\b(non comprare|senza comprare|niente acquisti|non acquistare)\b"
IF_CONFIRMED = r"\b(solo se conferm\w*|dopo (?:la |una |mia )?conferma|solo dopo (?:la |mia )?conferma|soltanto dopo che (?:te lo )?conferm\w*)\b"
THAT_MATTER = r"\b(ricordamelo|quella faccenda|quella cosa|cio di cui parlavamo)\b"
OURSELVES = r"\b(siamo in|senza (?:la )?(?:macchina|auto|automobile))\b"
COMPARE_SOME = r"\bconfronta(?:mi)?\s+(due|tre|quattro|cinque|sei|[2-6])\b"
ARRIVING, LEAVING, AT_HOUR = r"\b(arriv\w*|entro le)\b", r"\b(part\w*)\b", r"\b(?:alle|le)\s+\d{1,2}(?::\d{2})?\b"

# ---- fixed values: patterns of the guard of 1.3
SORTED = r"\b(?:ordina|ordinami)\b.*\b(?:per prezzo|per costo|dal pi[uù] economico|prezzo crescente)\b"
RENTING, SEARCHING = r"\b(?:noleggia|affitta|mi serve a noleggio)\b", r"\b(?:cerca|trova)\b"
ASK_FIRST = r"\b(?:chiedimi conferma|dopo la mia conferma|solo dopo conferma)\b"
PARTY = r"\b(?:siamo in|siamo un gruppo di)\s+(?:due|tre|quattro|cinque|sei|\d+)\b"
NO_CAR = r"\b(?:senza (?:la )?(?:macchina|auto)|non abbiamo (?:la )?(?:macchina|auto))\b"
LODGED = r"\b(?:abbiamo gi[aà] (?:l[' ]hotel|un hotel)|hotel gi[aà] prenotato)\b"

# ---- fixed values: patterns of the first layer
STORY, STORY_SAYS = r"\b(?:per un racconto|sto scrivendo una scena)\b", r"\b(?:immagina qualcuno che dica|un personaggio dice|non si tratta di una richiesta per te)\b"
DIRECT = r"\b(?:volo diretto|senza scali|senza scalo)\b"
NO_BOOKING_1 = r"\b(?:non prenotare|non prenotarne|senza prenotare|non fare (?:nessuna |alcuna )?prenotazione)\b"
NO_BUYING_1 = r"\b(?:non acquistare|senza acquistare)\b"
COMPARE_1 = r"\bconfronta(?:ne|mi)?\s+(?:esattamente\s+)?(due|tre|quattro|cinque|sei|[2-6])\b"
SHOW_1 = r"\b(?:mostra|elenca)(?:mi)?\s+(?:soltanto|solo|al massimo)\s+(due|tre|quattro|cinque|sei|[2-6])\b"
SEARCH_THEN_BOOK_1 = [r"\b(?:cerca|trova|individua|esplora)\b", r"\b(?:poi|dopo|quindi)\b", r"\bprenota\b"]

# ---- fixed values: patterns of the second layer
EXAMPLE, EXAMPLE_ONLY = r"\b(?:copione|sceneggiatura|lezione di italiano|esempio di comando|nota che ho copiato)\b", r"\b(?:mi dici|spiega|non eseguire|voglio solo|voglio soltanto)\b"
NO_BOOKING_2 = r"\b(?:non riservare|senza effettuare prenotazioni|niente prenotazioni|non bloccare|lascia a me la prenotazione)\b"
NO_BUYING_2 = r"\bnon comprare\b"
ARRIVE_BY = r"\b(?:arriv\w*|arrivo|essere a|raggiungere)\b.{0,100}\b(?:entro|prima delle|prima di|non oltre)\b"
BY_ARRIVAL = r"\b(?:entro|prima delle|prima di|non oltre)\b.{0,45}\barriv\w*\b"
ON_FOOT = r"\b(?:raggiungibil\w*|arrivare|arrivarci)\s+a piedi\b"
OPEN_NOW = r"\bapert[aoie]\s+(?:ora|adesso)\b"
FROM_PLACE, FROM_START = r"\b(?:parto da|partire da|treni da|treno da|autobus da)\b", r"\b(?:treno|treni|autobus|volo)\b"
SHOW_2 = r"\b(?:cerca|trova|mostrami|mostra|fammi vedere)\s+(?:al massimo\s+|soltanto\s+|solo\s+)?(due|tre|quattro|cinque|sei|[2-6])\b"
RESTAURANT = r"\bristorant\w*\b"
NO_RESULTS = r"\b(?:solo se non ce ne sono|se la ricerca restituisce zero risultati|solo in assenza di risultati|se non trovi corse)\b"
SEARCH_THEN_BOOK_2 = [r"\b(?:trova|cerca|individua|mostrami|mostra)\b", r"\bprenota\b", r"\b(?:poi|quindi|solo dopo)\b"]

# ---- fixed values: patterns of the third layer
CONFIRM_3 = (
    r"\b(?:chiedimi (?:prima )?(?:la )?(?:conferma|autorizzazione|ok|via libera)"
    r"|(?:dopo|con|previa) (?:il |la |mia |mio )*(?:mia |mio )?(?:conferma|autorizzazione|consenso|ok)"
    r"|(?:aspetta|attendi) (?:il |la )?(?:mio |mia )?(?:consenso|via libera|autorizzazione|conferma)"
    r"|(?:mostrami|fammi vedere).*?prima di (?:spedir\w*|inviar\w*|confermar\w*|pagare)"
    r"|(?:solo )?dopo che (?:l )?avr[oai] (?:approvato|confermato)"
    r"|solo quando (?:ti )?(?:dar[o ]+|avrai) (?:il )?(?:permesso|consenso|ok)"
    r"|non (?:spedire|inviare|prenotare|pagare|modificare).*?finche non confermo)\b"
)
NO_BUYING_3 = r"\b(?:senza (?:fare |effettuare )?(?:acquisti|comprare|acquistare)|senza comprare niente|non (?:comprare|acquistare|fare acquisti)|niente acquisti)\b"
NO_HIRING_3 = r"\b(?:non (?:assumere|ingaggiare)|senza (?:assumere|ingaggiare))\b"
NO_RENTING_3 = r"\b(?:non (?:affittare|noleggiare)|senza (?:affittare|noleggiare))\b"
GENERIC_PROVIDER = r"\b(?:idraulico|elettricista|fabbro|tecnico|muratore|imbianchino|giardiniere|riparatore)\b"
REMIND_AT = r"\b(?:alle\s+|(?:domani|dopodomani|oggi|lunedi|martedi|mercoledi|giovedi|venerdi|sabato|domenica)\s+alle\s+)(\d{1,2})(?::(\d{2}))?\b.{0,35}\b(?:ricordami|promemoria|avviso|imposta)\b"

# ---- fixed values: patterns of the fourth and fifth layers
APPROVE_4 = (
    r"\b(?:dopo (?:il )?mio si|prima di (?:procedere|impegnarmi) .*?(?:mostrami|chiedimi)"
    r"|prima di [^.;]{1,80}?(?:mostrami|fammi vedere|chiedimi)"
    r"|(?:mostrami|fammi vedere) prima (?:quale|quali|la|il)"
    r"|(?:attendi|aspetta) (?:la |il )?mia approvazione"
    r"|(?:solo )?quando (?:avrai|ti avro) (?:il |detto di )?(?:mio )?(?:assenso|si|procedere)"
    r"|(?:chiedimi|richiedi) (?:un )?si esplicito)\b"
)
NO_RENTING_4 = r"\b(?:senza (?:prenderne|prenderla|prenderlo|affittarne|noleggiarne)|non (?:prenderne|prenderla|prenderlo|affittarne|noleggiarne))\b"
NO_BUYING_4 = r"\b(?:non (?:comprarla|comprarlo|comprarne|acquistarla|acquistarlo|acquistarne)|non e un ordine d acquisto|l acquisto lo faro io)\b"
NO_HIRING_4 = r"\b(?:senza assumerlo|non assumerlo|senza ingaggiarlo|non ingaggiarlo)\b"
SELECT_4 = r"\b(?:prenota|riserva|compra|acquista|contatta|chiedi)\b.{0,50}?\b(primo|prima|secondo|seconda|terzo|terza|quarto|quarta)\b"
COMPARE_4 = r"\b(?:metti a confronto|confrontami|confronta|paragona)\s+(?:al massimo |soltanto |solo )?(due|tre|quattro|cinque|sei|[2-6])\b"
CHEAP_TO_DEAR = r"\b(?:dal meno caro al piu caro|dal piu economico al piu caro)\b"
RAIL = r"\b(?:treni?|ferroviari[oa]?|regionale)\b"
CONSENT_5 = r"\b(?:solo )?dopo che (?:ti )?(?:avro|avremo) (?:detto di procedere|dato (?:il )?(?:via libera|permesso|ok))\b|\b(?:solo )?dopo (?:il )?mio (?:via libera|permesso|consenso)\b"
NO_BOOKING_5 = r"\b(?:senza (?:prenotare|fare (?:la |una )?prenotazione|prenotarne|riservarne)|non (?:prenotare|prenotarne|riservarne)(?: (?:ancora|adesso|per ora))?|nessuna prenotazione(?: (?:per ora|adesso))?)\b"

_CODES = "array<string>"


def says(text: Column, *patterns: str) -> Column:
    """Whether a text holds a match of every pattern."""
    out = F.lit(True)
    for p in patterns:
        out &= text.rlike(f"(?U){p}")
    return out


def coded(rules: list[tuple[str, Column]]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(ok, F.lit(code)) for code, ok in rules)))).cast(_CODES)


def one_word(name: Column, names: list[str]) -> Column:
    """Whether one of a text's words is listed."""
    return has(F.regexp_extract_all(name, F.lit("([a-z]+)"), F.lit(1)), *names)


def kind(g: Column) -> Column:
    return F.coalesce(g["target"]["type"], F.lit(""))


def field_code(name: Column, allowed: list[str]) -> Column:
    """What is wrong with a field name for the planner, or null."""
    return F.when(name.isin(allowed), None).when(name.isin(ALIASES), "alias_requires_planner_mapping").otherwise("unknown_planner_field")


def firm(g: Column, field: str, *, op: str | None = None, value: str | float | bool | None = None) -> Column:
    """Whether a goal holds a hard fact of a field, of this value where one is named."""

    def fits(f: Column) -> Column:
        ok = (f["field"] == field) & (f["strength"] == "hard")
        if op:
            ok &= f["op"] == op
        if isinstance(value, bool):
            ok &= (f["value_kind"] == "b") & (f["value"] == str(value).lower())
        elif isinstance(value, str):
            ok &= (f["value_kind"] == "s") & (f["value"] == value)
        elif value is not None:
            ok &= number(f) == float(value)
        return F.coalesce(ok, F.lit(False))

    return F.exists(facts_of(g), fits)


def lone_act(goals: Column) -> Column:
    """The only goal that acts on the world; null where there is none or several."""
    acts = F.filter(goals, lambda g: g["action"].isin(V.CONSEQUENTIAL))
    return F.when(F.size(acts) == 1, F.get(acts, F.lit(0)))


def unconfirmed(goals: Column) -> Column:
    g = lone_act(goals)
    return g.isNotNull() & ~F.array_contains(confirmed(g), g["action"])


def ids_of(goals: Column, *actions: str) -> Column:
    return F.transform(F.filter(goals, lambda g: g["action"].isin(*actions)), lambda g: g["id"])


def uses_result(g: Column, ids: Column, ordinal: Column | None = None) -> Column:
    """Whether a goal depends on one of the goals and refers to a result of one."""

    def refers(f: Column) -> Column:
        ok = F.array_contains(ids, f["value_ref"]["goal"])
        return F.coalesce(ok & (f["value_ref"]["ordinal"] == ordinal) if ordinal is not None else ok, F.lit(False))

    return F.arrays_overlap(listed(g["depends_on"]), ids) & F.exists(facts_of(g), refers)


def limit_of(g: Column, name: str, want: Column) -> Column:
    """Whether a modifier differs from the number that the text names."""
    return want.isNotNull() & ~F.coalesce(g["modifiers"][name] == want, F.lit(False))


# ---------------------------------------------------------------- version 1.2


def codes_12(c: Column, said: Column) -> Column:
    """The first guard's codes for a sound contract 1.2."""
    return once(flat(said), lambda text: _codes_12(c, text))


def _codes_12(c: Column, text: Column) -> Column:
    goals = c["goals"]
    some = lambda f: F.exists(goals, f)
    name = lambda g: flat(F.coalesce(g["target"]["name"], F.lit("")))
    named = lambda g, names: once(name(g), lambda n: F.exists(V.words(names), lambda w: F.contains(n, w)))
    lacks = lambda g, *slots: F.size(F.array_except(V.words(list(slots)), fields_of(g))) > 0
    money = lambda f: f["field"].isin(V.MONEY_FIELDS)
    facts = F.flatten(F.transform(goals, facts_of))
    task = c["kind"] == "task"
    return coded(
        [
            ("declared_missing_input", some(lambda g: F.size(missing_of(g)) > 0)),
            ("explicit_confirmation_pending", some(lambda g: F.size(confirmed(g)) > 0)),
            ("table_booking_requires_details", some(lambda g: (g["action"] == "book") & named(g, TABLE_NAMES) & lacks(g, "date", "time", "guests"))),
            ("flight_booking_requires_details", some(lambda g: (g["action"] == "book") & named(g, FLIGHT_NAMES) & lacks(g, "origin", "date"))),
            ("contact_requires_message", some(lambda g: (g["action"] == "contact") & lacks(g, "message"))),
            ("negative_money_value", F.exists(facts, lambda f: F.coalesce(money(f) & (number(f) < 0), F.lit(False)))),
            ("nonpositive_price_ceiling", F.exists(facts, lambda f: F.coalesce(money(f) & (number(f) == 0) & f["op"].isin("lt", "lte"), F.lit(False)))),
            ("ungrounded_condition", some(lambda g: g["condition"].isNotNull()) & ~says(text, CONDITIONAL)),
            ("possible_missing_fallback_goal", task & says(text, FALLBACK) & (F.size(goals) < 2)),
            ("possible_missing_followup_goal", task & says(text, FOLLOW_UP) & (F.size(goals) < 2)),
            ("missing_price_ranking", task & says(text, CHEAPEST) & ~some(lambda g: F.coalesce((g["ranking"]["field"] == "price") & (g["ranking"]["direction"] == "asc"), F.lit(False)))),
            ("missing_explicit_booking_prohibition", task & says(text, DONT_BOOK) & ~some(lambda g: has(forbidden(g), "book"))),
            ("missing_explicit_purchase_prohibition", task & says(text, DONT_BUY) & ~some(lambda g: has(forbidden(g), "buy"))),
            ("missing_explicit_confirmation", task & says(text, IF_CONFIRMED) & ~some(lambda g: F.size(confirmed(g)) > 0)),
            ("unresolved_reminder_reference", task & says(text, THAT_MATTER) & some(lambda g: g["action"] == "notify") & ~F.exists(facts, lambda f: f["field"] == "message")),
            ("possible_missing_user_context", task & says(text, OURSELVES) & (F.coalesce(F.size(c["context"]), F.lit(0)) == 0)),
        ]
    )


def routing_12(c: Column, said: Column) -> Column:
    """Codes of the routing guard for a contract 1.2 that the first guard accepts."""
    return once(flat(said), lambda text: _routing_12(c, text))


def _routing_12(c: Column, text: Column) -> Column:
    asked = counted(text, COMPARE_SOME)
    table = F.create_map(*(F.lit(x) for kv in ROUTED.items() for x in kv))

    def rules(g: Column) -> Column:
        action, name, fields = g["action"], flat(F.coalesce(g["target"]["name"], F.lit(""))), fields_of(g)
        fam = F.coalesce(F.try_element_at(table, kind(g)), F.lit(""))
        ride = (action == "find") & one_word(name, TRANSPORTS)
        return coded(
            [
                ("notify_target_not_reminder", (action == "notify") & (fam != "reminder")),
                ("notify_message_unresolved", (action == "notify") & ~has(fields, "message") & ~has(missing_of(g), "message", "referent")),
                ("appointment_routing_mismatch", (action == "cancel") & one_word(name, ["visita", "appuntamento"]) & (fam != "appointment")),
                ("vehicle_routing_mismatch", (action == "rent") & one_word(name, VEHICLES) & (fam != "vehicle")),
                ("professional_routing_mismatch", action.isin("find", "hire") & one_word(name, PROFESSIONALS) & (fam != "professional_service")),
                ("comparison_quantity_missing", (action == "compare") & asked.isNotNull() & ~F.exists(facts_of(g), lambda f: F.coalesce((f["field"] == "quantity") & (f["op"] == "eq") & (number(f) == asked), F.lit(False)))),
                ("transport_time_role_ambiguous", ride & F.exists(facts_of(g), lambda f: (f["field"] == "time") & f["op"].isin("before", "after"))),
                ("arrival_time_field_missing", ride & says(text, ARRIVING, AT_HOUR) & ~has(fields, "arrival_time")),
                ("departure_time_field_missing", ride & says(text, LEAVING, AT_HOUR) & ~has(fields, "departure_time")),
            ]
        )

    return F.array_distinct(F.flatten(F.transform(c["goals"], rules)))


# ---------------------------------------------------------------- version 1.3


def grounding(c: Column, said: Column) -> Column:
    """What the words of a request demand of its contract."""
    text, goals = F.lower(said), c["goals"]
    context = listed(F.transform(c["context"], lambda x: x["field"]))
    return coded(
        [
            ("sort_misread_as_order", says(text, SORTED) & F.exists(goals, lambda g: g["action"] == "order")),
            ("rental_misread_as_find", says(text, RENTING) & ~says(text, SEARCHING) & F.exists(goals, lambda g: (g["action"] == "find") & (kind(g) == "vehicle"))),
            ("confirmation_not_bound_to_action", says(text, ASK_FIRST) & unconfirmed(goals)),
            ("missing_user_context", (says(text, PARTY) & ~has(context, "party_size")) | (says(text, NO_CAR) & ~has(context, "has_car")) | (says(text, LODGED) & ~has(context, "lodging_owned"))),
        ]
    )


def layer_1(c: Column, text: Column) -> Column:
    goals = c["goals"]
    fields = F.concat(
        listed(F.transform(c["context"], lambda x: field_code(x["field"], CONTEXT_FIELDS))),
        F.flatten(F.transform(goals, lambda g: F.transform(facts_of(g), lambda f: field_code(f["field"], FACT_FIELDS)))),
        F.transform(F.filter(goals, lambda g: g["condition"].isNotNull()), lambda g: field_code(g["condition"]["test"]["field"], RESULT_FIELDS)),
    )
    shows, compares = counted(text, SHOW_1), counted(text, COMPARE_1)

    def rules(g: Column) -> Column:
        action = g["action"]
        return coded(
            [
                ("direct_flight_constraint_missing", (kind(g) == "transport") & says(F.lower(g["target"]["name"]), r"\b(?:volo|aereo|flight)\b") & says(text, DIRECT) & ~firm(g, "stops", op="eq", value=0.0)),
                ("explicit_no_booking_policy_missing", says(text, NO_BOOKING_1) & ((action == "book") | ((kind(g) == "accommodation") & (action == "find") & ~has(forbidden(g), "book")))),
                ("explicit_no_purchase_policy_missing", says(text, NO_BUYING_1) & ((action == "buy") | ((kind(g) == "transport") & (action == "find") & ~has(forbidden(g), "buy")))),
                ("compare_cardinality_missing", (action == "compare") & limit_of(g, "compare_count", compares)),
                ("result_limit_missing", (action == "find") & limit_of(g, "limit", shows)),
            ]
        )

    finds = ids_of(goals, "find")
    books = F.filter(goals, lambda g: g["action"] == "book")
    both = says(text, *SEARCH_THEN_BOOK_1)
    lost = (F.size(finds) == 0) | (F.size(books) == 0)
    idle = (c["kind"] == "non_actionable") & (F.size(goals) == 0)
    whole = coded(
        [
            ("quoted_command_misread_as_action", says(text, STORY, STORY_SAYS) & ~idle),
            ("requested_booking_goal_missing", both & lost),
            ("booking_result_dependency_missing", both & ~lost & ~F.exists(books, lambda b: uses_result(b, finds))),
        ]
    )
    return F.array_distinct(F.concat(F.array_compact(fields), F.flatten(F.transform(goals, rules)), whole))


def layer_2(c: Column, text: Column) -> Column:
    goals = c["goals"]
    arrival = says(text, ARRIVE_BY) | says(text, BY_ARRIVAL)
    departs = says(text, FROM_PLACE) | (F.startswith(text, F.lit("da ")) & says(text, FROM_START))
    shows = counted(text, SHOW_2)

    def rules(g: Column) -> Column:
        action, typ = g["action"], kind(g)
        place, ride = (action == "find") & typ.isin("place", "accommodation"), (action == "find") & (typ == "transport")
        held, lacking = F.concat(fields_of(g), roles_of(g)), missing_of(g)
        open_slot = lambda slot, said: ~F.array_contains(held, F.lit(slot)) & ~F.array_contains(lacking, F.lit(said))
        slots = open_slot("action_date", "date") | open_slot("action_time", "time") | open_slot("guests", "guests")
        return coded(
            [
                ("explicit_no_booking_policy_missing_v2", says(text, NO_BOOKING_2) & ((action == "book") | (action.isin("find", "compare") & (typ == "accommodation") & ~has(forbidden(g), "book")))),
                ("explicit_no_purchase_policy_missing_v2", says(text, NO_BUYING_2) & ((action == "buy") | (ride & ~has(forbidden(g), "buy")))),
                ("arrival_deadline_role_missing", ride & arrival & ~has(roles_of(g), "arrival_time")),
                ("explicit_origin_missing", ride & departs & ~firm(g, "origin")),
                ("walking_access_missing", place & says(text, ON_FOOT) & ~firm(g, "access", value="a piedi")),
                ("open_now_missing", place & says(text, OPEN_NOW) & ~firm(g, "open_now", value=True)),
                ("result_limit_missing_v2", (action == "find") & limit_of(g, "limit", shows)),
                ("restaurant_booking_slots_missing", (action == "book") & (typ == "place") & says(plain(g["target"]["name"]), RESTAURANT) & slots),
            ]
        )

    finds = ids_of(goals, "find")
    books = F.filter(goals, lambda g: g["action"] == "book")
    both = says(text, *SEARCH_THEN_BOOK_2)
    lost = (F.size(finds) == 0) | (F.size(books) == 0)
    idle = (c["kind"] == "non_actionable") & (F.size(goals) == 0)

    def falls_back(g: Column) -> Column:
        test = g["condition"]["test"]
        return F.coalesce((test["field"] == "results_count") & (test["op"] == "eq") & (number(test) == 0) & F.array_contains(listed(g["depends_on"]), g["condition"]["goal"]), F.lit(False))

    whole = coded(
        [
            ("quoted_example_misread_as_action", says(text, EXAMPLE, EXAMPLE_ONLY) & ~idle),
            ("zero_results_fallback_missing", says(text, NO_RESULTS) & ~F.exists(F.slice(goals, 2, F.greatest(F.size(goals), F.lit(1))), falls_back)),
            ("requested_booking_goal_missing_v2", both & lost),
            ("booking_result_dependency_missing_v2", both & ~lost & ~F.exists(books, lambda b: uses_result(b, finds))),
        ]
    )
    return F.array_distinct(F.concat(F.flatten(F.transform(goals, rules)), whole))


def layer_3(c: Column, text: Column) -> Column:
    goals = c["goals"]
    before = F.regexp_extract(text, "^([^'\"«]*)", 1)
    hour, minute = F.regexp_extract(before, REMIND_AT, 1), F.regexp_extract(before, REMIND_AT, 2)
    clock = F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.when(minute == "", "00").otherwise(minute)))

    def rules(g: Column) -> Column:
        action, typ, forbid = g["action"], kind(g), forbidden(g)
        free = lambda *acts: F.size(F.array_except(V.words(list(acts)), forbid)) > 0
        food = typ == "food"
        bought = (food & action.isin("buy", "order")) | (~food & (action == "buy"))
        may_buy = F.when(food, free("buy", "order")).otherwise(free("buy"))
        chosen = F.exists(facts_of(g), lambda f: (f["field"] == "selection") & f["value_ref"].isNotNull())
        told = F.exists(times_of(g), lambda t: F.coalesce((t["role"] == "notification_time") & (t["value_kind"] == "s") & (t["value"] == clock), F.lit(False)))
        return coded(
            [
                ("explicit_no_purchase_policy_missing_v3", says(text, NO_BUYING_3) & typ.isin("food", "product", "transport") & (bought | (action.isin("find", "compare") & may_buy))),
                ("explicit_no_hire_policy_missing_v3", says(text, NO_HIRING_3) & (typ == "professional_service") & ((action == "hire") | ((action == "find") & free("hire")))),
                ("explicit_no_rent_policy_missing_v3", says(text, NO_RENTING_3) & (typ == "vehicle") & ((action == "rent") | (action.isin("find", "compare") & free("rent")))),
                ("provider_identity_missing_v3", (action == "hire") & (typ == "professional_service") & says(plain(g["target"]["name"]), GENERIC_PROVIDER) & ~chosen & ~has(missing_of(g), "provider")),
                ("explicit_reminder_time_mismatch_v3", (action == "notify") & (typ == "reminder") & clock.isNotNull() & ~told),
            ]
        )

    return F.array_distinct(F.concat(coded([("explicit_confirmation_missing_v3", says(text, CONFIRM_3) & unconfirmed(goals))]), F.flatten(F.transform(goals, rules))))


def layer_4(c: Column, text: Column) -> Column:
    goals = c["goals"]
    compares, chosen = counted(text, COMPARE_4), F.regexp_extract(text, SELECT_4, 1)
    ordinal = F.try_element_at(F.create_map(*(F.lit(x) for kv in ORDINALS.items() for x in kv)), chosen)

    def rules(g: Column) -> Column:
        action, typ, forbid = g["action"], kind(g), forbidden(g)
        look = action.isin("find", "compare")
        by_price = F.coalesce((g["modifiers"]["sort"]["field"] == "price") & (g["modifiers"]["sort"]["direction"] == "asc"), F.lit(False))
        return coded(
            [
                ("explicit_no_rent_policy_missing_v4", says(text, NO_RENTING_4) & (typ == "vehicle") & ((action == "rent") | (look & ~has(forbid, "rent")))),
                ("explicit_no_purchase_policy_missing_v4", says(text, NO_BUYING_4) & typ.isin("product", "food") & (action.isin("buy", "order") | (look & ~has(forbid, "buy")))),
                ("explicit_no_hire_policy_missing_v4", says(text, NO_HIRING_4) & (typ == "professional_service") & ((action == "hire") | ((action == "find") & ~has(forbid, "hire")))),
                ("compare_count_missing_v4", (action == "compare") & limit_of(g, "compare_count", compares)),
                ("explicit_price_sort_missing_v4", (action == "compare") & says(text, CHEAP_TO_DEAR) & ~by_price),
                ("rail_mode_not_bound_to_target_v4", (action == "find") & (typ == "transport") & plain(g["target"]["name"]).isin("trasporto", "mezzo", "collegamento") & says(text, RAIL)),
            ]
        )

    sources = ids_of(goals, "find", "compare")
    later = F.filter(goals, lambda g: g["action"].isin("book", "buy", "contact"))
    unbound = (F.size(sources) > 0) & (F.size(later) > 0) & ~F.exists(later, lambda g: uses_result(g, sources, ordinal))
    whole = coded([("explicit_approval_missing_v4", says(text, APPROVE_4) & unconfirmed(goals)), ("ordinal_result_reference_missing_v4", (chosen != "") & unbound)])
    return F.array_distinct(F.concat(whole, F.flatten(F.transform(goals, rules))))


def layer_5(c: Column, text: Column) -> Column:
    goals = c["goals"]
    bookable = lambda g: kind(g).isin("accommodation", "place", "transport", "appointment")
    unsaid = F.exists(goals, lambda g: bookable(g) & ((g["action"] == "book") | (g["action"].isin("find", "compare") & ~has(forbidden(g), "book"))))
    return coded([("explicit_delayed_consent_missing_v5", says(text, CONSENT_5) & unconfirmed(goals)), ("explicit_no_book_policy_missing_v5", says(text, NO_BOOKING_5) & unsaid)])


def _any(codes: Column, *parts: str) -> Column:
    return F.exists(codes, lambda x: x.rlike("|".join(parts)))


#: A layer's codes, and the status that they give an accepted contract: the first whose pattern a code matches.
LAYERS: list[tuple[Callable[[Column, Column], Column], list[tuple[str, str]]]] = [
    (layer_1, [("^quoted_command", CONFLICT), ("policy", POLICY), ("field|alias|dependency", UNSUPPORTED), ("", LACKING)]),
    (layer_2, [("^quoted_", CONFLICT), ("policy", POLICY), ("dependency|fallback|booking_goal", UNSUPPORTED), ("", LACKING)]),
    (layer_3, [("policy|confirmation", POLICY), ("", LACKING)]),
    (layer_4, [("policy|approval", POLICY), ("", LACKING)]),
    (layer_5, [("", POLICY)]),
]
_UNSUPPORTED = "^(unsupported_action_target|order_sort_confusion|sort_misread_as_order|rental_misread_as_find|vehicle_target_mismatch|notify_target_mismatch)$"
#: The same for the guard of 1.3 itself.
BASE = [("^schema|^unsupported_version$|^not_object$", INVALID), ("^conflicting_hard_equality$|^policy_conflict$", CONFLICT), ("policy|confirmation", POLICY), ("missing_required|^cardinality_lost$", LACKING), (_UNSUPPORTED, UNSUPPORTED), ("", CLARIFY)]


def status_of(codes: Column, order: list[tuple[str, str]]) -> Column:
    out = F.when(F.size(codes) == 0, ACCEPT)
    for pattern, status in order:
        out = out.when(_any(codes, pattern), status)
    return out


def _read(cases: DataFrame) -> DataFrame:
    """cases (raw, text) with the typed contract, and why it can't be read."""
    raw = F.coalesce(F.col("raw"), F.lit(""))
    x = cases.withColumn("__c", parsed(raw)).withColumn("__shape", structure(raw, c=F.col("__c"))).withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    json = F.try_parse_json(raw)
    return x.withColumn("__broken", F.when(json.isNull(), "invalid_json").when(~F.schema_of_variant(json).startswith("OBJECT"), "not_object")).withColumn("__version", F.coalesce(F.col("__c.schema_version"), F.lit("")))


def _out(x: DataFrame, cases: DataFrame) -> DataFrame:
    """The columns of cases, then status and codes (which replace columns of those names)."""
    return x.select(*(c for c in cases.columns if c not in ("status", "codes")), F.col("__status").alias("status"), F.col("__codes").alias("codes"))


def _codes(issues: Column) -> Column:
    return F.array_distinct(F.transform(issues, lambda i: i["code"]))


def _sound(x: DataFrame) -> DataFrame:
    """__wrong: the structural codes of a contract 1.2."""
    rules = F.when(F.size("__shape") > 0, F.array(F.lit("schema"))).otherwise(_codes(V.rules_12(F.col("__c"))))
    return x.withColumn("__wrong", F.when(F.col("__version") == "1.2", rules).otherwise(F.array(F.lit("unsupported_version"))))


def guard_12(cases: DataFrame, *, routing: bool = False) -> DataFrame:
    """cases (raw, text, ...) with status (ACCEPT, REVIEW or REJECT) and codes of contracts 1.2; `routing` asks the routing guard too."""
    c, text = F.col("__c"), F.col("__text")
    x = _sound(_read(cases))
    found = F.when(F.col("__broken").isNotNull(), F.array("__broken")).when(F.size("__wrong") > 0, F.transform("__wrong", lambda w: F.concat(F.lit("schema:"), w))).otherwise(codes_12(c, text))
    x = x.withColumn("__codes", F.array_sort(found))
    hard = F.col("__broken").isNotNull() | (F.size("__wrong") > 0) | _any(F.col("__codes"), "^(negative_money_value|nonpositive_price_ceiling)$")
    x = x.withColumn("__status", F.when(hard, REJECT).when(F.size("__codes") > 0, REVIEW).otherwise(ACCEPT))
    out = _out(x, cases)
    return with_routing(out) if routing else out


def with_routing(judged: DataFrame) -> DataFrame:
    """judged (raw, text, status, codes) by the guard of 1.2, after the routing guard's say on what that accepts.

    Over a written table of verdicts only the routing rules are worked out.
    """
    said = F.coalesce(F.col("text"), F.lit(""))
    own = F.when(F.col("status") == ACCEPT, once(parsed(F.col("raw")), lambda c: F.array_sort(routing_12(c, said))))
    return judged.select(
        *(F.col(c) for c in judged.columns if c not in ("status", "codes")),
        once(F.struct(own.alias("own"), F.col("status"), F.col("codes")), lambda v: F.when(F.size(v["own"]) > 0, F.struct(F.lit(REVIEW).alias("status"), v["own"].alias("codes"))).otherwise(F.struct(v["status"].alias("status"), v["codes"].alias("codes")))).alias("__verdict"),
    ).select(*(F.col(c) for c in judged.columns if c not in ("status", "codes")), "__verdict.status", "__verdict.codes")


def guard_13(cases: DataFrame, *, layers: int = 5) -> DataFrame:
    """cases (raw, text, ...) with status and codes of the guard of 1.3 and its first `layers` routing layers.

    Contracts 1.2 are asked the guards of their own version as well. Null texts are empty; null or broken
    JSON is REJECT_INVALID.
    """
    c, text = F.col("__c"), F.col("__text")
    x = _sound(_read(cases))
    old = F.when(F.size("__wrong") > 0, F.transform("__wrong", lambda w: F.concat(F.lit("schema_or_v12:"), w))).otherwise(_codes(V.meaning_12(c, text)))
    new = F.when(F.size("__shape") > 0, F.array(F.lit("schema"))).otherwise(_codes(V.rules_13(c, text)))
    found = F.when(F.col("__broken").isNotNull(), F.array("__broken")).when(F.col("__version") == "1.2", old).when(F.col("__version") == "1.3", new).otherwise(F.array(F.lit("unsupported_version")))
    x = x.withColumn("__issues", found)
    readable = ~_any(F.col("__issues"), "^schema", "^unsupported_version$", "^invalid_json$", "^not_object$")
    x = x.withColumn("__readable", readable)
    x = x.withColumn("__codes", F.when(F.col("__readable"), F.array_sort(F.array_union("__issues", grounding(c, text)))).otherwise(F.array_sort("__issues")))
    x = x.withColumn("__status", F.when(F.col("__broken") == "invalid_json", INVALID).otherwise(status_of(F.col("__codes"), BASE)))
    # a contract 1.2 without issues is asked its own guards
    ours = (F.col("__status") == ACCEPT) & (F.col("__version") == "1.2")
    x = x.withColumn("__old", F.when(ours, codes_12(c, text)))
    x = x.withColumn("__old_hard", F.coalesce(_any(F.col("__old"), "^(negative_money_value|nonpositive_price_ceiling)$"), F.lit(False)))
    x = x.withColumn("__old", F.when(ours & (F.size("__old") == 0), routing_12(c, text)).otherwise(F.col("__old")))
    x = x.withColumn("__status", F.when(F.col("__old_hard"), INVALID).when(F.coalesce(F.size("__old"), F.lit(0)) > 0, CLARIFY).otherwise(F.col("__status"))).withColumn("__codes", F.coalesce(F.when(F.size("__old") > 0, F.array_sort("__old")), F.col("__codes")))
    moved = (F.col("__status") == ACCEPT) & F.exists(c["goals"], lambda g: g["action"] == "reschedule")
    x = x.withColumn("__codes", F.when(moved, F.array(F.lit("reschedule_provider_not_verified"))).otherwise(F.col("__codes"))).withColumn("__status", F.when(moved, UNSUPPORTED).otherwise(F.col("__status")))
    x = x.withColumn("__plain", plain(text))
    for layer, order in LAYERS[:layers]:
        asked = (F.col("__status") != INVALID) & (F.col("__version") == "1.3")
        x = x.withColumn("__own", F.when(asked, layer(c, F.col("__plain"))).otherwise(F.array().cast(_CODES)))
        x = x.withColumn("__status", F.when((F.col("__status") == ACCEPT) & (F.size("__own") > 0), status_of(F.array_union("__codes", "__own"), order)).otherwise(F.col("__status"))).withColumn("__codes", F.array_sort(F.array_union("__codes", "__own")))
    return _out(x, cases)
