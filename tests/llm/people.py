"""Labelled sentences whose patterns and values all differ from those the personal-data field learns from."""

import random

PATTERNS = (
    "yesterday my name is {name} was all they could say", "please call {name} if the train is late", "Mr {name} left the house at dawn", "Mrs. {name} sold both horses", "Dr. {name} gave a lecture on bees", "Dear {name} we have received your order",
    "a man named {name} opened the shop", "a woman called {name} painted it", "the letter was signed by {name} in ink", "Customer: {name} wants a refund", "Patient: {name} has a fever", "Frau {name} kam zu spät", "el señor {name} compró pan", "Monsieur {name} est en retard",
    "he said I am {name} and sat down", "Name: {name} and nothing else", "je m'appelle {name} dit la voix", "me llamo {name} dijo la niña", "this poem was written by {name} long ago", "we met {name} near the harbour",
    "we live at {street} since autumn", "deliver it to {street} after lunch", "their address is {street} for now", "Address: {street} and that is all", "I live at {street} with two cats", "Frau Klein wohnt in der {street} ganz oben",
    "SSN: {ssn} for now", "my SSN is {ssn} and yours is not", "her social security number is {ssn} by law", "born on {birth} at sea", "DOB: {birth} as stated", "geboren am {birth} im Dorf", "IBAN: {iban} is valid", "transfer it to IBAN {iban} tonight",
    "nobody came to the harbour that night", "The Mayor and the Bishop met in Vienna.", "in 1999 some 250 houses stood here", "dear reader please sit down", "the name of the ship was painted on it", "call a taxi at noon", "ship it to the warehouse", "Tickets for Berlin and Prague cost 12 dollars",
)
FIRST = ("Barack", "Xiuying", "Astrid", "Magnus", "Leopold", "Beatrix", "Thandiwe", "Kwame", "Zainab", "Rashid", "Svetlana", "Dmitri", "Aoife", "Ciarán", "Xavier", "Noémie", "Ulrich", "Waltraud", "Esperanza", "Joaquín")
LAST = ("Obama", "Zhang", "Lindqvist", "Haugen", "Vandenberg", "Achterberg", "Nkosi", "Boateng", "Hussain", "Volkov", "Gallagher", "Byrne", "Delacroix", "Lefèvre", "Zimmermann", "Krause", "Quintero", "Villanueva", "Mendoza", "Whitfield")
STREETS = ("221B Baker Street", "12 Elm Drive", "7 Chestnut Lane", "48 Willow Avenue", "1600 Pennsylvania Ave", "5 Harbour View Road", "Gartenstraße 9", "Birkenweg 14", "31 rue de Rivoli", "Calle Serrano 22", "90 Abbey Road")


def table(rows, seed=5):
    """(text, [(kind, start, end)]) of sentences, every pattern used in turn."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    value = {
        "name": lambda: f"{rng.choice(FIRST)} {rng.choice(LAST)}", "street": lambda: rng.choice(STREETS), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "birth": lambda: rng.choice((f"{digits(2)}/{digits(2)}/19{digits(2)}", f"{digits(2)}.{digits(2)}.19{digits(2)}")), "iban": lambda: f"{rng.choice(('NL', 'AT', 'PT'))}{digits(20)}",
    }
    out = []
    for i in range(rows):
        before, _, rest = PATTERNS[i % len(PATTERNS)].partition("{")
        kind, _, after = rest.partition("}")
        text = value[kind]() if kind else ""
        out.append((before + text + after, [(kind, len(before), len(before) + len(text))] if kind else []))
    return out
