"""The small labelled table the personal-data model is trained from.

Fixed values: patterns of sentences in four languages, lists of names and words; the table is the seeded
combination of them. {name}, {mail} and so on are labelled spans, all other words are outside. Most names are
invented from syllables, so that a name is known by its shape and the words around it and not by heart, and
many sentences have invented words outside all spans, so that an unknown or capitalised word alone is no sign of one.
"""

from __future__ import annotations

import numpy as np

# Fixed values.
PATTERNS = (
    "please contact {name} at {mail} for details", "my name is {name} and I live at {street}", "my name is {name} and I live in the north",
    "call {name} on {phone} before noon", "write to {mail} or call {phone}", "I live at {street} with my family", "she lives at {street} near the river",
    "the parcel goes to {street} in the old town", "send it to {street} by Monday", "his address is {street} as before", "address: {street}", "Address: {street}",
    "born on {birth} in the north", "he was born on {birth} they say", "Mr {name} paid with card {card} last week", "Mr. {name} wrote to us again",
    "Mrs {name} came to the office", "Mrs. {name} has signed the form", "Ms {name} asked for a copy", "Ms. {name} will call back", "Dr {name} wrote the second chapter", "Dr. {name} saw the patient today",
    "Prof. {name} gave the talk", "Professor {name} teaches here", "Dear {name} thank you for the letter", "Name: {name}", "name: {name}", "Full name: {name}", "Patient: {name}", "Customer: {name} paid in full",
    "signed by {name} on Monday", "written by {name} in the spring", "her name was {name} and she was kind", "a man named {name} came by", "a woman called {name} answered the door", "this is {name} speaking",
    "I am {name} from the bank", "I spoke with {name} about it", "we met {name} at the station", "the account of {name} was closed", "ask {name} for the key", "according to {name} it was late", "sincerely {name}", "Sincerely, {name}", "Regards, {name}",
    "she gave {name} the book", "the book by {name} sold well", "told {name} about the plan", "with {name} and the others", "der Brief von {name} kam heute", "das Haus gehört {name} seit Jahren", "la carta de {name} llegó hoy", "le livre de {name} est beau", "el señor {name} compra el libro", "Monsieur {name} arrive demain", "Frau {name} wohnt in der {street} seit Jahren", "Herr {name} schrieb an {mail} gestern", "ich heiße {name} und komme aus dem Norden", "mein Name ist {name} und ich wohne {street} im Süden", "Sehr geehrter Herr {name}", "die Adresse ist {street} seit Mai",
    "Madame {name} habite au {street} depuis longtemps", "Monsieur {name} appelle le {phone} demain", "je m'appelle {name} et je viens du sud", "son adresse est {street} maintenant", "M. {name} a signé la lettre", "Mme {name} est partie",
    "la señora {name} vive en {street} desde entonces", "el señor {name} escribe a {mail} hoy", "me llamo {name} y vivo en {street} aquí", "mi nombre es {name} y trabajo mucho", "Sr. {name} llamó ayer", "Sra. {name} no está",
    "server {ip} did not answer", "login from {ip} by {mail} was refused", "her social security number is {ssn} she said", "SSN: {ssn}", "ssn {ssn} on file", "SSN {ssn} was used twice", "the number {ssn} is his SSN", "my SSN is {ssn} as you know", "his social security number is {ssn} and mine is lost", "social security number: {ssn}", "Social Security {ssn}",
    "account {iban} was closed in May", "IBAN: {iban}", "pay to IBAN {iban} today", "my IBAN is {iban} now", "send it to {iban} please", "Konto {iban} ist leer", "geboren am {birth} in der Stadt", "né le {birth} à la ville", "nacido el {birth} en el sur",
    "date of birth {birth} on the form", "Date of birth: {birth}", "DOB: {birth}", "dob {birth} and height", "nacida el {birth} aquí", "born {birth} in a village", "geb. {birth} im Süden", "birthday {birth} every year",
    "the river runs past the mill and the long road", "In the morning the market opens at nine", "die alte Brücke über den Fluss ist seit 1890 gesperrt",
    "le marché ouvre le matin dans la rue", "las casas de la calle son blancas", "version 2.0 of the licence came out in 2004", "Chapter 12 has 340 pages and 7 maps", "The Queen and the King met in Rome.",
    "password=29e5b7d2b3fc74d679 and more words", "the total was 1,250.75 for 3 items in 1999", "please contact the office for details", "my name is hard to spell", "we live at the end of the road", "call the office before noon",
    "the address is wrong and the name of the town is new", "the table was made by hand", "I am late and this is true", "dear all please read the page", "Name: unknown", "Address: none given", "the number 12-34 is no code", "order 123-456 came on Monday 12",
    "Mr and Mrs were there", "born in the north of the country", "ask for the key", "written by hand", "according to the Times it was late", "the New York office opened in 2010 with 12 people", "Monday and Tuesday in March or April", "under the Apache License Version 2.0 and the MIT License",
)
FIRST = (
    "Anna", "John", "Maria", "Peter", "Lucía", "Jürgen", "Élodie", "Tom", "Sofia", "Karl", "Inés", "Paul", "Emma", "Liam", "Olivia", "Noah", "Ava", "James", "Mia", "Lucas", "Clara", "Hugo", "Alice", "Louis",
    "Carlos", "Elena", "Diego", "Pablo", "Hans", "Greta", "Otto", "Ingrid", "Claire", "Michel", "Yuki", "Hiroshi", "Priya", "Arjun", "Fatima", "Omar", "Ivan", "Olga", "Chen", "Mei", "Kofi", "Amara", "Robert", "Mary",
)
LAST = (
    "Smith", "Müller", "García", "Dupont", "Jones", "Weber", "Moreau", "López", "Brown", "Fischer", "Taylor", "Wilson", "Davies", "Evans", "Schmidt", "Schneider", "Wagner", "Becker", "Martin", "Bernard", "Petit", "Durand",
    "Fernández", "Sánchez", "Pérez", "Gómez", "Rossi", "Bianchi", "Novak", "Kowalski", "Ivanov", "Tanaka", "Sato", "Kim", "Park", "Wang", "Li", "Singh", "Patel", "Khan", "Ali", "Okafor", "Mensah", "Silva", "Santos", "Costa", "O'Neill", "McKay",
)
HEADS = ("b", "br", "c", "ch", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "r", "s", "sch", "st", "t", "tr", "v", "w", "y", "z", "")
CORES = ("a", "e", "i", "o", "u", "ai", "ei", "ou", "é", "ö", "í", "ee")
TAILS = ("n", "r", "s", "l", "m", "ck", "t", "ng", "nd", "", "", "")
FUNCTION = tuple("the of by to with and in is was at from for on as or not this that it he she I am la le de el en y et un une der die das und in von zu mit ist the of to by with name call contact".split())
PARTICLES = ("van", "von", "de", "de la", "del", "di", "al", "bin")
ROADS = ("Road", "Rd", "Street", "St", "St.", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Way", "Court", "Close", "Place", "Square", "Boulevard", "Blvd")


def invented(rng: np.random.Generator, least: int = 1, most: int = 3) -> str:
    """A word of random syllables."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = "".join(pick(HEADS) + pick(CORES) + pick(TAILS) for _ in range(int(rng.integers(least, most + 1))))
    return word if len(word) > 1 else word + "n"


def table(rows: int = 900, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Sentences as lists of (word, label); labels are O, B-KIND and I-KIND."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda options: options[int(rng.integers(len(options)))]
    new = lambda: invented(rng).capitalize()
    part = lambda known: new() if rng.random() < 0.75 else pick(known)

    def name() -> str:
        first, last, form = part(FIRST), part(LAST), rng.random()
        if form < 0.08:
            return f"{first} {pick(PARTICLES)} {last}"
        if form < 0.16:
            return f"{first} {pick('ABCDEFGHJKLMNPRSTVW')}. {last}"
        if form < 0.22:
            return f"{first}-{part(FIRST)} {last}"
        return f"{first} {last}-{part(LAST)}" if form < 0.27 else f"{first} {part(FIRST)} {last}" if form < 0.33 else last if form < 0.43 else f"{first} {last}"

    def street() -> str:
        n = digits(int(rng.integers(1, 4))) + (pick("ABCabc") if rng.random() < 0.15 else "")
        english = f"{n} {new()} {pick(ROADS)}" if rng.random() < 0.75 else f"{n} {new()} {new()} {pick(ROADS)}"
        if rng.random() < 0.2:
            english += f", {new()}"
        return pick((english, english, english, f"{new()}{pick(('straße', 'weg', 'gasse', 'platz', 'allee'))} {n}", f"{n} rue {pick(('de', 'du', 'des', 'Saint'))} {new()}", f"{n} avenue {new()}", f"Calle {new()} {n}", f"Avenida {new()} {n}"))

    value = {
        "name": name,
        "mail": lambda: f"{pick((pick(FIRST), invented(rng))).lower()}.{pick((digits(2), invented(rng)))}@{invented(rng)}{pick(('', digits(1)))}.{pick(('example.com', 'org', 'net', 'de'))}",
        "street": street,
        "phone": lambda: pick((f"+1 ({digits(3)}) 555-{digits(4)}", f"+49 30 {digits(7)}", f"({digits(3)}) 555-{digits(4)}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}")),
        "birth": lambda: pick((f"{digits(2)}/{digits(2)}/19{digits(2)}", f"{digits(2)}.{digits(2)}.19{digits(2)}", f"{pick(('19', '20'))}{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(1)}/{digits(1)}/20{digits(2)}")),
        "card": lambda: pick((digits(16), " ".join(digits(4) for _ in range(4)))),
        "ip": lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: f"{pick(('DE', 'FR', 'ES', 'GB', 'IT'))}{digits(20)}",
    }
    letters = list("aaeeiioouunrstlmdchpgbvfäéíóüñç")
    loose = lambda: "".join(rng.choice(letters, int(rng.integers(1, 13)))) if rng.random() < 0.5 else invented(rng, 1, 4)

    def prose(words: int) -> list[tuple[str, str]]:
        """Invented words with capitals where sentences begin, and a few elsewhere, none of it personal; some lines say one word again and again."""
        if rng.random() < 0.12:
            word = pick((loose(), "de", "und", "the")).capitalize()
            return [(word, "O")] * words
        out, begins, stop, high = [], True, rng.random() * 0.4, pick((0.0, 0.06, 0.3))
        for _ in range(words):
            end = pick((".", ".", ".", "!!", "|", ";", ",")) if rng.random() < stop else ""
            word = pick(FUNCTION) if rng.random() < 0.25 else loose()
            out.append(((word.capitalize() if begins or rng.random() < high else word) + end, "O"))
            begins = end in (".", "!!")
        return out

    out = []
    for r in range(rows):
        if r % 5 < 2:
            out.append(prose(int(rng.integers(1, 30))))
            continue
        sentence = prose(int(rng.integers(1, 8))) if rng.random() < 0.3 else []
        close = pick(("", "", "", ".", ",", ";"))
        for word in pick(PATTERNS).split():
            kind = word.strip("{}")
            if word[0] == "{":
                sentence += [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(value[kind]().split())]
                if close:  # punctuation hangs on the last word of a span as often as not
                    sentence[-1] = (sentence[-1][0] + close, sentence[-1][1])
            else:
                sentence.append((word, "O"))
        if rng.random() < 0.3:
            sentence += prose(int(rng.integers(1, 8)))
        out.append(sentence)
    return out
