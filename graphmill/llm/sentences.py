"""Made-up sentences with and without personal information, to fit and to calibrate the search for it.

The frames were written for this module from common forms of letters, signatures, forms, commit trailers, tables and
logs in four languages; none is taken from the data. What is put into them is drawn by a seeded generator: names and places
from syllables and from words of a public vocabulary that stand in it with a capital only, titles from its common words.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator
from functools import cache

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

WITH = (
    "{name} wrote the first draft in March.", "We met {name} at the conference.", "This was checked by {name} last week.", "Many thanks to {name} for the help.", "My manager is {name}.",
    "Better talk to {name}, not to the machine.", "{name} and {name2} joined the meeting late.", "The contract was signed by {name} on Friday.", "Dr. {name} presents the results.", "You can reach {name} at {email}.",
    "{name} ({email}) owns this part.", "Hi {name},\n", "Dear Ms. {name},", "Dear {name},", "Hello {name},", "Kind regards,\n{name}", "Best wishes\n{name}\n{phone}\n", "-- \n{name}\n{address}\n", "Patient: {name}, born in 1980.", "Bill to: {name}, {address}",
    "Parcels go to {address}.", "She lives at {address} with her sister.", "Our new office: {address}", "My number is {phone}", "Tel: {phone}", "Fax {phone}", "Ring {phone} after lunch.", "Phone: {phone} (evenings)", "Text me on {phone}.", "Mail {email} for details.",
    "Mail {email} or dial {phone}.", "email={email}", "contact: {email}", "To: {name} <{email}>", "From: {name} <{email}>\n", "Cc: {email}, {email2}", "Co-authored-by: {name} <{email}>", "Acked-by: {name} <{email}>\n", "Tested-by: {name}", "Reported-by: {name} ", "Suggested-by: {name}", "Tested-by: {name} {Word} is next.", "(room booked for {name})", "{phone} (see {name})", "Room {n} (key with {name})", "Maintainer: {name}",
    "maintainers:\n  - {name}\n", "{name}, {email}, {phone}", "{name}\t{phone}\t{address}", '"customer": "{name}", "mobile": "{phone}"', '"applicant": "{name}", "{label}": "{identity}"', "user_name: {name}", "<td>{name}</td><td>{phone}</td>",
    "| {phone} | {name} |", "| {email} | {n} | {phone} |", "His {label} is {identity}.", "{label}: {identity}", "{label} {identity} was typed in by {name}.", "the {label} ({identity}) must not be kept", "applicant {name}, {label} {identity}",
    "last seen by {name} on the stairs", "I told {name} that it works.", "{name} said no.", "{name} is on leave until Monday.", "assigned to {name}", "owner={name};", "who={name} where={address} no={label}: {identity}", "{name};{email};{phone};{label} {identity}",
    "{email};{phone};{address}", "{phone},{email}", "{name};{phone};{email}\n", "{name};{n};{email}", "\n{name};{email};{n}\n", "guest list: {name}, {name2}", "as {name} pointed out", "Yesterday {name} fell ill.", "Today {name} opens the shop.", "Then {name} came in.", "Per {name}, it rains.", "Since {name} left, all is calm.", "speak with {name}", "- {name}: {phone}", "* {name} <{email}>", "@author {name}", "Copyright (c) 2024 {name}", "request from {email} failed",
    "q={email}&page={n}", "Home: {address}; work: {phone}", '"street": "{address}"', "{name}: I am late, call {phone}", "Emergency: {phone} or {phone2}", "{n}. {name}, {address}", "write {email}", "[{name}](mailto:{email})",
    "{name} hat den Fehler behoben.", "Mit freundlichen Grüßen\n{name}\n", "Sehr geehrte Frau {name},", "Ansprechpartner: {name}, Tel. {phone}", "Wenden Sie sich bitte an {name}.", "Anschrift: {address}", "Meine {label} lautet {identity}.",
    "von {name} geprüft", "Geprüft von {name}.", "Freigegeben von {name} ({email})", "Betreut von {name}", "erreichbar unter {phone}", "Kontakt: {email}", "Herr {name} wohnt hier: {address}", "Die {label} {identity} gehört {name}.", "Frag {name} nach dem Schlüssel.", "Hallo {name}!", "wie {name} sagte, ist das fertig", "Gestern kam {name} zu spät.", "Laut {name} regnet es.", "Heute kocht {name}.",  "Post bitte an {address} schicken.", "E-Mail an {email} genügt.",
    "Cordialement,\n{name}\n", "Bonjour {name},", "Cher {name},", "d'après {name}, tout est prêt", "Selon {name}, il pleut.", "Hier {name} dormait.", "Contactez {name} au {phone}.", "écrit par {name} en mai", "{name} a corrigé le problème.", "Domicile : {address}", "Mon {label} est {identity}.", "M. {name} habite au {address}.", "Courriel : {email}",
    "Madame {name} arrive demain.", "Le {label} {identity} est celui de {name}.", "Joindre {name} : {phone}", "Colis à déposer au {address}.", "Tél. : {phone}",
    "Estimada Sra. {name}:", "Estimado {name}:", "Querida {name}:", "Querido {name}:\n", "Un saludo,\n{name}\n", "como dijo {name}, ya está", "Según {name}, llueve.", "Ayer {name} llegó tarde.", "Hola {name},", "Escrito por {name}.", "{name} corrigió el error.", "Mi {label} es {identity}.", "Vive en {address}.", "Teléfono: {phone}", "Correo: {email}", "Don {name} llega mañana.", "El {label} {identity} es de {name}.",
    "Pregunta a {name} por la llave.", "Paquetes a {address}.", "Se puede llamar al {phone} o escribir a {email}.",
)
WITHOUT = (
    "{thing} is out now.", "# {thing}\n", "See the {thing} for details.", "We use {thing} and {thing2}.", "Edition {n} of {thing} was printed.", "The {thing} reads the {thing2}.", "Chapter {n}: {thing}", "In {place}, trains run late.", "The team flew to {place}.",
    "Thanks, {given}, that was quick.", "Thanks, {given}!", "Hello, {given}.", "Danke, {given}, das war gut.", "Merci, {given}, tout va bien.", "Gracias, {given}, está bien.", "Well, {given} knows.", "Sorry, {given}, no time.", "{given} said so.", "{given} and {given2} agreed.",
    "On Monday, {given} left.", "Press Enter, Escape or Tab.", "{thing}, {thing2} and more.", "Bug {n}: {thing} fails", "Set {thing} to On.", "Edit > {thing} > {thing2}", "- {thing}\n- {thing2}\n", "| {thing} | {n} |", '"title": "{thing}"', "name: {thing}", "label={thing};",
    "{n} {thing} and {d2} {thing2}", "{n} {Word} Classes, {d2} {thing}.", "Das ist {thing}.", "Der {thing} liest den {thing2}.", "Le {thing} est prêt.", "El {thing} falla.", "Launch {thing} after {thing2} is done.", "It moves from {thing} to {thing2}.", "{thing}:", "Part {n}, {thing}", "powered by {thing}",
    "built with {thing}", "{place} has {n} bridges.", "trains to {place}", "{place} and {place2} are twin towns.", "a letter from {place}", "We moved from {brand} to {brand2}.", "runs on {brand}", "{brand} was updated.", "Install {brand} first.", "Made in {place}.", "The {place} office is closed.", "by {thing}", "with {thing}", "cc {given}", "ask {given} first", "Dear {given},", "Hallo {given},", "Hola {given}:", "Bonjour {given},", "Bitte {word} nicht starten.", "{Word} {word} {Word}.",
    "Job {d9} ended.", "Node 10.2.{d2}.{d3}:80{d2} answers.", "{d3}-{d3}-{d3} pieces", "Mask 0x{d9}", "lines {d3} {d3} {d3} were cut", "at 2024-03-1{d} 10:{d2}:{d2}.{d3}", "v{d}.{d2}.{d3}", "total: {d3} {d3} {d3} bytes", "invoice A{d9}", "ref {d9}", "ports 80{d2} 81{d2}", "sum {d9} of {d9}", "range {d3}-{d3}",
    "file_{d9}.txt", "sha {d9}a7b", "ratio {d3}/{d3}", "{d2} {d3} {d3} {d3} entries", "part {d9}Z", "+{d2} {d3} {d3} ms slower", "took +{d3} {d2} {d3} us", "{d3} {d2} {d2} {d2} samples", "id X{d9}", "case {d3}-{d2}-{d3} is open", "temperature -{d2} to +{d2}", "serial {d3}.{d3}.{d3}", "{d9} rows in {d3} s", "item {d2}.{d3}.{d3}-B", "batch {d9}", "key {d8}Z was rotated", "Runs {d8}Q and {d8}B differ.", "lot K{d8}", "{d8}T", "part no. X{d2}{d3}{d2}", "{d2}.{d3}.{d3}-A is a drawing", "drawer {d2} {d3} {d3} {d3}",
    "git@host.example:team/{word}.git", "ssh://git@host.example/{word}.git", "npm i {word}@1.{d}.{d2}", "@{word}/core", "@{Word} void run()", "scp x root@10.0.0.{d2}:/tmp", "fetch git@code.test:{word}/{word}.git now", "{word}-kit@{d}.{d2}.{d3}", "pip install {word}@main", "hg@repo.example/{word}",
    "Road {n} is closed.", "{n} Open Roads", "rue du code {n}", "Platz {n} ist frei.", "Weg {n} war kürzer.", "An avenue of {n} trees.", "Calle sin salida {n}", "Street {n} on the map", "{n} Way Valve", "Ring {n} of {d2}", "Park {n} cars", "{n} place holders", "Close {n} tabs", "Row {n} of {d3}", "Avenue {word} runs by {d3} houses.", "Via {Word} {d2} was used.",
)
#: Numbers joined to others, where one proposal covers parts of two; these set no threshold.
JOINED = ("Dial {phone}\n{phone}\n", "{name}\n{phone}\n{phone}\n{word}", "door 80{d2} {phone} for {word}", "Numbers: {phone} {phone}", "| {d3} {phone} | {word} |", "phone {phone}\n{d2}", "{phone} - {phone}")


@cache
def vocabulary(paths: tuple[str, ...] = VOCABULARIES) -> frozenset[str]:
    """The tokens of the public vocabularies that are words of letters with a blank before them.

    Of three letters or fewer many are but the beginnings of words; these count only where the vocabulary ranks them
    before the same with a capital.
    """
    out: dict[str, int] = {}
    for path in paths:
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    word = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
                    if word[:1] == " " and word[1:].isalpha():
                        out[word[1:]] = min(int(line.split()[1]), out.get(word[1:], 1 << 30))
    return frozenset(w for w, rank in out.items() if len(w) > 3 or w[0].isupper() or rank < out.get(w.capitalize(), 1 << 30))


@cache
def _pools(paths: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(words with a capital only, common words) of the vocabularies, in a fixed order."""
    known = vocabulary(paths)
    proper = sorted(w for w in known if w[0].isupper() and w[1:].islower() and 3 <= len(w) <= 10 and w.lower() not in known)
    common = sorted(w for w in known if w.isascii() and w.islower() and 4 <= len(w) <= 9)
    return proper, common


def fill(pick: random.Random, paths: tuple[str, ...] = VOCABULARIES) -> dict[str, str]:
    """Made-up values for the fields of the frames."""
    proper, common = _pools(paths)
    syllable = lambda n: "".join(pick.choice("bdfghklmnprstvz") + pick.choice("aeiou") + pick.choice(("", "", "n", "r", "l", "st", "h", "k")) for _ in range(n))
    d = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    rare = lambda share: syllable(pick.choice((2, 2, 3))).capitalize() if pick.random() < share else pick.choice(proper)
    given, given2 = rare(0.55), rare(0.55)
    surname = pick.choice(common).capitalize() if pick.random() < 0.08 else rare(0.75)
    if pick.random() < 0.1:
        surname += "-" + syllable(2).capitalize()
    part = pick.choice(("", "", "", "", "", "van der ", "de la ", "von "))

    second = rare(0.6)

    def named(given: str, surname: str) -> str:
        full = pick.choice((f"{given} {part}{surname}",) * 5 + (f"{given[0]}. {surname}",) * 3 + (f"{given} {second} {surname}", f"{given} {pick.choice('ABDKRT')}. {surname}", f"{surname}, {given}", f"{given} {surname}".upper()))
        return full.replace(" ", "\n", 1) if pick.random() < 0.05 else full

    word, word2 = pick.choice(common), pick.choice(common)
    host = pick.choice(("mail", "corp", "uni", "dev.team", syllable(2))) + "." + pick.choice(("example", "test", "org", "com", "net"))
    local = pick.choice((f"{given}.{surname}", f"{given[0]}{surname}", f"{surname}+{word}", f"{given}_{surname}{d(2)}", f"{given}{d(3)}", f"{given}-{surname}")).lower().replace(" ", "")
    local = re.sub(r"[^\w.+-]", "", local.encode("ascii", "ignore").decode()) or "box"
    email = lambda: pick.choice((f"{local}@{host}",) * 4 + (f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local}(at){host}", f"{local} at {host.replace('.', ' dot ')}", f"{local}%40{host}", f"{local}@{host}".upper()))
    phone = lambda: pick.choice((f"+1-555-555-{d(4)}", f"(555) 555-{d(4)}", f"555.555.{d(4)}", f"+1 555 555 {d(4)}", f"+44 7700 {d(6)}", f"07700 {d(6)}", f"+49 30 {d(5)} {d(3)}", f"(030) {d(8)}", f"030 / {d(5)}-{d(3)}", f"0049 (0)30 {d(8)}",
                                 f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"01.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33 (0)1 {d(2)} {d(2)} {d(2)} {d(2)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 600 {d(3)} {d(3)}", f"600 {d(3)} {d(3)}", f"(+34) 600{d(6)}", f"600-{d(2)}-{d(2)}-{d(2)}"))
    label, ident = pick.choice((("SSN", f"9{d(2)}-{d(2)}-{d(4)}"), ("social security number", f"9{d(2)} {d(2)} {d(4)}"), ("passport", f"{pick.choice('KLMNU')}{d(8)}"), ("National Insurance no.", f"QQ {d(2)} {d(2)} {d(2)} {pick.choice('ABCD')}"),
                               ("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("Steuer-IdNr.", d(11)), ("NIR", f"1{d(14)}"), ("n° de sécurité sociale", f"2 {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"), ("DNI", f"{d(8)}{pick.choice('ABTR')}"), ("DNI nº", f"{d(2)}.{d(3)}.{d(3)}-{pick.choice('TRWA')}"), ("NIE", f"X-{d(7)}-{pick.choice('ABTR')}"), ("pasaporte", f"{pick.choice('XPA')}{pick.choice('ABC')}{d(6)}")))
    town, road, n = rare(0.6), rare(0.6), str(pick.randint(1, 250))
    address = pick.choice((f"{n} {road} {pick.choice(('Street', 'Road', 'Lane', 'Row', 'Close', 'Rd', 'Ave.'))}, {town} {d(5)}", f"Flat {pick.randint(1, 30)}, {n} {road} Road, {town}", f"{n} bis, avenue {road}, {d(5)} {town}", f"{n} chemin {road}, {d(5)} {town}",
                           f"{n}, rue {road}, {d(5)} {town}", f"{road}weg {n}, {d(5)} {town}", f"{road}straße {n}a, {d(5)} {town}", f"Am {road}berg {n}, {d(5)} {town}", f"{road}gasse {n}b, {d(5)} {town}", f"{road}str. {n}b, {d(5)} {town}", f"Calle {road}, {n}, {d(5)} {town}", f"{n} {road} Lane"))
    telephone = phone()
    if pick.random() < 0.06:
        telephone, ident = telephone.replace(" ", "\n", 1), ident.replace(" ", "\n", 1)
    if pick.random() < 0.15:
        at = pick.choice([i for i, c in enumerate(address) if c == " "])
        address = address[:at] + "\n" + address[at + 1 :]
    elif pick.random() < 0.15:
        address = address.replace(", ", "\n", 1) if address[:4] != "Flat" else address
    titled = lambda: " ".join(pick.choice(common).capitalize() for _ in range(pick.choice((2, 2, 2, 3))))
    place = pick.choice((pick.choice(proper), f"{pick.choice(common).capitalize()} {rare(0.5)}", f"San {rare(0.5)}"))
    brand = lambda: f"{pick.choice(proper)} {pick.choice((pick.choice(common).capitalize(), pick.choice(proper)))}"
    return {
        "brand": brand(), "brand2": brand(), "place2": f"{rare(0.3)}{pick.choice(('', ' City', ' Valley'))}", "d8": d(8),
        "name": named(given, surname), "name2": named(given2, rare(0.75)), "email": email(), "email2": email(), "phone": telephone, "phone2": phone(), "identity": ident, "address": address, "label": label,
        "word": word, "Word": word2.capitalize(), "thing": titled(), "thing2": titled(), "place": place, "n": n, "d": d(1), "d2": d(2), "d3": d(3), "d9": d(9), "given": given, "given2": given2,
    }


_LEADS = ("", "", "All is quiet today. ", "Rien de neuf. ", "\n", "chat: ", "> ", "Alles gut. ", "Todo bien. ")
_TAILS = ("", "", " The old box holds 30 MB.", "\n", " More on this tomorrow.")


def sentence(frame: str, pick: random.Random, kinds: tuple[str, ...]) -> tuple[str, set[tuple[str, int, int]]]:
    """A frame with values and the (kind, start, end) of what is personal in it."""
    values = fill(pick)
    text, truth = pick.choice(_LEADS), set()
    for literal, field in re.findall(r"([^{]*)(?:\{(\w+)\})?", frame):
        text += literal
        if field:
            if (kind := field.rstrip("2")) in kinds:
                truth.add((kind, len(text), len(text) + len(values[field])))
            text += values[field]
    return text + pick.choice(_TAILS), truth


def sample(size: int, seed: int, kinds: tuple[str, ...]) -> Iterator[tuple[str, set[tuple[str, int, int]], str]]:
    """`size` sentences with and as many without personal information, and a tenth more with joined numbers.

    The third field is fit, held or joined. Every fourth frame is held out as a whole: it sets thresholds, no tree sees it.
    """
    pick = random.Random(seed)
    for n in range(size + size // 10):
        if n >= size:
            yield *sentence(pick.choice(JOINED), pick, kinds), "joined"
            continue
        for frames in (WITH, WITHOUT):
            at = pick.randrange(len(frames))
            yield *sentence(frames[at], pick, kinds), "held" if at % 4 == 3 else "fit"
