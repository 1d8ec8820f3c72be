"""Labelled sentences for the redaction models.

There are no labelled documents, so the models are fitted on a bounded number of sentences built here: frames in seven
languages with slots for personal data in its written forms, and frames with look-alikes that are none. Frames and
fillers are written for this purpose; none is taken from a corpus. Half of the people come from the caller's
directory, the others from the lists and syllables below, so that the trees know names with and without a directory entry.
Everything is drawn from one seed.
"""

from __future__ import annotations

import random
import re

# {P} person, {E} email, {T} phone, {I} id number with its label, {A} {D} {F} {S} address (English, German, French, Spanish and Italian form), {M} title
# or nothing, {L} town; lower-case slots are fillers without personal data. Frames are parted by '|', '\n' and '\t' are breaks.
FRAMES = r"""
{P} will present the results.|Spoke with {P} {w}.|Written by {P}|Author: {P}|Manager: {P}, deputy: {P}|Hi {P},\n{s}|Dear {M}{P},\n\n{s}|{s}\n\nBest wishes\n{P}\n{r}\n{T}|{s}\n\nKind regards,\n{P}|{s}\n{P}\n{r}\n{E}
{M}{P} moved to {L} {w}.|{P} and {P} signed the minutes.|Present: {P}, {P}, {P} (minutes)|{P}'s laptop was replaced.|The complaint came from {M}{P}; {s}|Forward it to {P} <{E}>.|To: {P} <{E}>; {P} <{E}>|<b>{P}</b> {s}|<td>{P}</td><td>{T}</td>
name: {P}\nmail: {E}\nphone: {T}|{P};{E};{T};{A}|{P}\t{T}\t{A}|{P} \| {E} \| {I}|"name": "{P}", "mail": "{E}", "tel": "{T}"|'contact'='{P}'|user={P}&mail={E}|{{name:"{P}",street:"{A}",tel:"{T}"}}|\| {P} \| {T} \| {E} \||{n2},{P},{E},{T}
You can reach {P} at {T}.|Ring {T} after lunch.|Phone: {T}|Tel {T}, {w}|My number is {T}.|Text me on {T} or write to {E}.|Fax {T}; mail {E}|Call {P} on {T} ext. {n3}|{P}: {T}|Office {T} / mobile {T}|({T})|T: {T}\nE: {E}|{T}\n{E}\n|Their hotline {T} was busy {w}.|Dial {T} x{n2} and ask for {P}.|{T} was engaged {w}.|{T} is the new line.|{T} {s}.|{T} answers only {w}.|{s}\n{T} goes to the mailbox.
Her {I} was typed into the comment.|{I}, {s}|{P} ({I}) {s}|{I}|Someone pasted {I} into the chat.|Form lists {I} and {A}.|Please delete {I} from the log.|{P}, {I}, {A}|{s} {I}.|{w} {P} {s}.|{P} {s} {w}.|{I}\n{s}|\| {I} \| {A} \||born 1984, {I}|"{I}"|We hold {I} for {P}.|{T}\t{I}\t{P}
Home: {A}, {L}|Parcel goes to {A}, {L}.|She lives at {A}.|{P}, {A}, {L}|{A}\n{L}|Meet us at {A} ({w}).|Old address {A}; new address {A}.|address={A}|"street": "{A}"|The van stopped outside {A}, Flat 4, {L}.|Return the keys to {A}, Unit 7.|He moved from {A} to {A} {w}.|({A}, {L})|deliver to {P}, {A}, {L}.|{A}
{P} wird das vorstellen.|Bitte {P} anrufen: {T}.|Ansprechpartner: {P}|Sehr geehrte Frau {P},\n{s}|Viele Grüße\n{P}|{P} wohnt in der {D}.|Anschrift: {D}, {L}|Herr {P} hat unterschrieben.|Unter {T} erreichen Sie {P}.|Lieferung an {D} in {L}.|{P} meldet: {s}|Tel.: {T}\n{E}|Der Eintrag nennt {I}.|Die Karte liegt bei {P}, {D}.
{P} enverra le document.|Écrire à {P} ({E}).|Bien à vous,\n{P}|Tél. {T}|Appelez {P} au {T}.|Domicile : {F}, {L}.|Elle habite {F}.|Mme {P} a signé.|Le dossier contient {I}.|Livrer au {F} à {L}.|{P} demande une copie.|Adresse : {F}
{P} enviará el documento.|Escribir a {P} ({E}).|Un cordial saludo,\n{P}|Tel. {T}|Llamar a {P} al {T}.|Domicilio: {S}, {L}.|Vive en {S}.|La señora {P} ha firmado.|Consta {I}.|Entregar en {S} de {L}.|{P} pide una copia.|Dirección: {S}
{P} manderà il documento.|Scrivere a {P} ({E}).|Cordiali saluti\n{P}|Abita in {S}, {L}.|Telefono {T}|{P} envia o documento.|Morada: {S}, {L}.|Com os melhores cumprimentos,\n{P}|{P} stuurt het document.|Met vriendelijke groet,\n{P}|Bel {P} op {T}.
Approved by {P} on {w}.|Signed: {P}|per {P}, {s}|as {P} put it, {s}|cc: {P}, {E}|Thanks {P}!|Thanks,\n{P}|Cheers, {P}|Yours, {P}|{S1}, {P}|Thank you, {P}.|It was {P} who found it.|Both {P} and {g} agreed.|{g} and {P} disagreed.|With {P} away, {s}|{P} says {s}.|Interview with {P} (notes)|{w} {P} called.|Ask {M}{P} first.|{V} {P} {w}.|{V} {P}.|We {V2} {P} about it.|They {V2} {P} {w}.|Please {V2} {P} for the {t}.|agreed with {P} {w}|{B} {P}.|{B} {P} {w}.|{B} {M}{P} and {P}.|{K}: {P}, {P}|{K}: {P}|{N}: {P}, {P} and {P}|The {P} record is old.|the {P} entry {s}|{s}, {P} said.|{V} {P} ({E}).|{P} has it.|Owner {P} / none|{P} {s}.|Created for {P}.|{P}\n\n{s}|{s}: {P}.
""".strip()
# Frames without personal data.
OTHERS = r"""
Order {n8} was shipped {w}.|Invoice {n4}-{n6} is due.|{c} {n4}-{n4}-{n2} is solved.|{c} no. {n7}|{c} #{n6}: {s}|{c} {n3}-{n4}|{c}: {n9}|({c} {n9})|({c} {n4}-{n3}-{n2})|{c} {n3}-{n4}-{n4} {w}|{c} {n10}|{c} {n3} {n3} {n3}|Version {n1}.{n2}.{n3} runs on {n2} hosts.|Host {n2}.{n2}.{n3}.{n2} answered.|Staff ID S{n6} has left.|Staff no. {n7}, {s}|{n4}-{d2}-{d2} {d2}:{d2}:{d2} started|{d2}/{d2}/20{d2}|{d2}.{d2}.20{d2}, {d2}:{d2}|20{d2}-{d2}-{d2}
{n2} of {n3} items fit.|{n3},{n3}.{n2} in total|{n1},{n3},{n3} rows read|{n2}% of {n2} checks pass|serial {n5}-{n5}|commit {h8}|checksum {h8} differs|sku {h8}-{n4}|Sum {n6}.{n2}, page {n3}|lines {n3}-{n3}|sheet {n2}/{n2}|row {n4} of sheet {n1}|{n4} {n4} {n4} files|Seite {n2} von {n2}|Aktenzeichen {n4}-{n4} läuft.|Auftrag {n7}, {s}|Expediente {n4}-{n4} resuelto.|Pedido {n8}|Référence {n4}-{n4} close.|Commande {n7} reçue.|{c} {n5}-{n4} ist offen.|account {n10}|meter reading {n6}|rank {n3}
The {G} {N} {t} opens {w}.|At the {G} {N} {t} {s}.|the {G} {t} is closed|{G} {t} needs paint|the {N} {N} {t}|{N} {N} {t} {n4}|{N} {N} {N} {n4}|{N} {N} {N} {N}|{R} {n4}|{R}|Compare {R} with {R} {n4}.|In {R} {n4} {s}.|{R} {n4} {s}.|Copy of {R} {n3}|{R} - {N} {N}|Subject: {R}|Re: {R} {n4}|"{R}"|\| {R} \| {n4} \||{t}s near {G} {t} {s}|{N} {t}|the {G} {N} code|the {G} {N} step|our {G} {N} plan|{G} {N} {t} or {G} {N} {t}?|see {G} {N} {t}|{G} {N} rules
{N} {U}. {S1}.|the {t} {U}. {N} {v}.|{s}, see {N} {U}. {K} {s}.|{s}.|{s}|; {v}\n|\| {v} \| {v} \||{v}\n{v}\n|({v})|"{v}"|<p>{v}</p>|{c}: {v}|{v}; {v}\n|{K} {K} {s}.|{K} {v}|{w}, {K} {K}|{K}, {K} und {K}|{K} nach {K} {w}.|{g} {w}: {s}.|{S1} {w}.|Next {N}: {s}|Dear all,\n{s}|Hi team,\n{s}|{N} and {N} differ.|Kind regards\nThe {N} {t}|Agenda: {N}, {N}, {N}|{N}, {N} and {N}|{N} > {N} > {N}|Open the {N} {N} menu.|Press Save As, then {N}.|{N}: {s}|{L} and {L} are behind.|From {L} to {L}|Human Resources, {L}|New {L}, North {L}|University of {L}|Bank of {L}|{N} {w}, {N} {w}|{N} {K} {v}|the {K} {N} {s}|{N} {v} {w}, {N} {v}|{g} {s} {w}; {v} {s}|{K} {s}; {K} {s}|{S1}: {v} {w}|the {N} in {L} {s}|{n2} {t}s on {N} {t}|{n2} chairs at {G} {N} {t}|{n3} people from {L} {t}|{n2} boxes at {L} road depot|{n3} steps along the way|{n2} rows in the park {t}|{n2} lines on the street {t}|{n4} {N} {N} road map|in 20{d2} the court said no|{n2} days to close
Bitte {s}.|{N} und {N} prüfen.|Im {N} fehlt der {N}.|Le {N} {N} reste ouvert.|La {N} de {L}|El {N} {N} sigue igual.|Los {N} de {L}|Guten Tag zusammen,\n{s}|Bonjour à tous,\n{s}|Hola a todos,\n{s}|Weg {n2} ist frei.|{n2} place libre|{n3} cours {w}|plaza libre {n2}|Platz {n2}|ring {n2} times|avenue {n2} of {n3}|seed {n6}|room {n4}, floor {n1}|handle @{g2}|@{g2} please look|price @ {n2} each|key {H8}|(key {H8})|checksum {H8} and {H8}|ID {H8} in the log|{c} {H8}|meet at {d2}:{d2}|see {g2}@ for more|{n3} @ {n2} {t}s
""".strip()
# Names of many countries, to write sentences with.
GIVEN = "Amelia Olivia Jonathan Walter Gregory Deborah Kenneth Brigitte Dieter Ulrike Wolfgang Käthe Jean-Luc Océane Gaëtan Solène Antoine Íñigo Macarena Gonzalo Pilar Ximena Matteo Ginevra Tommaso Fiorella João Inês Thiago Joost Sanne Maarten Femke Sigrid Torben Astrid Eero Aino Björn Kjersti Wojciech Agnieszka Zbigniew Jiří Božena Zsófia Gábor Ilie Ioana Stavros Eleni Vesna Goran Oleksandr Yelena Arkady Svetlana Aslı Emre Yusuf Khadija Amina Bilal Farid Layla Shirin Arash Rohan Ananya Vikram Meera Arjun Sunita Imran Ayesha Nimal Thi Quang Linh Somchai Nur Putri Budi Hiroshi Sakura Takumi Min-jun Seo-yeon Jiayi Xiuying Guang Mei-Ling Chinedu Ngozi Adaeze Kofi Abena Sipho Thandiwe Wanjiru Kamau Tendai Kaia Malia Tane Nayeli".split()
FAMILIES = "Whitfield Pemberton Hargreaves O'Malley MacGregor Fairchild Underwood Blackwood Schulz Krüger Weißmann Oberländer Bachmeier Lefèvre Rousseau Chevalier Marchand D'Amico Ferrante Lombardi Benedetti Echeverría Zubizarreta Navarro Quiroga Figueroa Nogueira Carvalho Teixeira Verhoeven Hoekstra Dijkstra Nygård Lindholm Sørensen Kjeldsen Virtanen Koskinen Nowakowski Szczepański Dvořák Horáček Kovács Szabó Popescu Ionescu Papadakis Georgiou Jovanović Marković Shevchuk Kravets Volkov Morozov Yıldız Demirci Haddad Mansour Rahimi Karimi Chatterjee Banerjee Reddy Pillai Malhotra Hussain Qureshi Perera Trần Phạm Wongsakul Santoso Wijaya Tanaka Kobayashi Fujimoto Park Kwon Zhou Huang Lau Eze Nwosu Adeyemi Mensah Boateng Dlamini Nkosi Mwangi Otieno Moyo Kealoha Tamihana Quispe".split()
SYLLABLES = "ba bel bor cal cor dan dor el en far fen gal gor hal har il jor kal kar lan lor mar mel nar nor ol or pel per quin ral ren ros sal sen sor tal tel tor ul val ven ver wal wen yor zan zel".split()
ENDINGS = "a berg den dale er ez field ford hof i ić in ini man mann nen o off ovic ova ro sen ski son stad ström ten ton ula wald well wick wright".split()
NOUNS = "Harbour Meadow Summit Victory Freedom Quarter Growth Harvest Network Budget Planning Training Overtime Absence Payment Security Access Customer Vendor Asset Travel Health Safety Quality Signal Transfer Hiring Exit Mentor Skill Award Salary Audit Inventory Forecast Market Channel Margin Cost Energy Water River Forest Garden Winter Bridge Corner North West Central Global Regional Interim Annual Weekly Final Shared Master Main Core Open Default Special Private Green Silver Golden Royal Old New Rise Grow Connect Lift Bloom Orbit Compass Pending Ready Submit Detail".split()
THINGS = "site campus building tower room hall bridge park road street station clinic school depot warehouse team group desk project programme scheme plan policy queue workflow form code module fund grant week event council committee report dashboard summary tracker extract scorecard list roster office plant".split()
FILL = {
    "w": ["yesterday", "on Tuesday", "this morning", "in the afternoon", "after the holidays", "twice", "in May", "next year", "before noon", "again", "by Friday", "late in June"],
    "s": ["the import stops halfway", "nobody answers", "we need another week", "numbers do not add up", "the screen stays blank", "it works on my machine", "the figures look fine", "please check the totals", "a filter is missing", "the link is broken", "we agreed to wait", "nothing was saved", "the old copy is gone", "das Ergebnis fehlt noch", "le total est faux", "falta una columna"],
    "v": ["open issues", "second draft", "no change", "three old copies", "late again", "broken layout, again", "to be checked", "some other rows", "missing values", "under review", "empty cells, mostly", "left as is", "six more weeks", "red numbers"],
    "K": ["Abteilung", "Zusammenfassung", "Beschluss", "Rückfrage", "Hinweis", "Auswertung", "Frist", "Vorlage", "Quartal", "Umsatz", "Personal", "Übersicht", "Hello", "Attached", "Several", "Nine", "Others", "Between", "Against", "Seven", "Meanwhile", "However", "Despite", "Réunion", "Bilan", "Resumen", "Informe"],
    "V": ["Met", "Called", "Asked", "Emailed", "Visited", "Met with", "Handed to", "Checked by", "Written for", "Owned by", "Tested by", "Prévenez", "Écrivez à", "Avisar a", "Consultar con", "Fragen Sie", "Chiamare", "Appelez", "Voyez", "Llamar a", "Ruf", "Vedi", "Confirmed by", "Agreed with", "Passed to"],
    "V2": ["ask", "asked", "call", "called", "told", "met", "thank", "warned", "remind", "tell", "email", "paid", "trained", "invite"],
    "B": ["from", "by", "with", "for", "about", "via", "against", "without", "behind", "Only", "Even", "Besides", "Like", "von", "mit", "für", "pour", "avec", "para", "con"],
    "U": list("ABCDEFGHK"),
    "S1": ["Everyone agreed", "Nobody objected", "Work continues", "Tests pass", "Nothing changed", "Costs went up"],
    "g": ["the finance team", "a colleague", "both auditors", "our partners", "the committee", "two interns", "everyone else"],
    "g2": ["helpdesk", "operations", "frontdesk", "all-hands", "reviewers"],
    "r": ["Senior Analyst", "Head of Operations", "Project Lead", "Payroll clerk", "Data engineering", "Customer care", "Office manager"],
    "c": ["Ticket", "ticket", "Case", "case", "order", "Invoice", "invoice", "item", "serial", "ref", "tracking", "part", "reference", "job", "asset tag", "lot", "request", "Ref.", "shipment", "receipt", "claim", "release"],
    "M": ["", "", "", "Mr ", "Ms. ", "Dr. ", "Mrs ", "Prof. "],
    "L": ["Ashford", "Glenrothes", "Kassel", "Grenoble", "Zaragoza", "Bergamo", "Utrecht", "Uppsala", "Tampere", "Coimbra", "Gdynia", "Boulder", "Halifax", "Dunedin", "Nakuru", "Pune"],
}
EN_STREETS = "Maple Oak Church Mulberry Station Victoria Juniper Foxglove Quarry Abbey Cedar Lincoln Jefferson Orchard Beacon Willow Kingsley Bramble Rosewood Harcourt Tennyson Falcon".split()
EN_TYPES = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Terrace Way Blvd Boulevard Close Place Crescent Square Hill Gardens Grove Park Mews Row Walk Highway Parkway Circle Trail".split()
ID_LABELS = {
    "us": ["SSN", "SSN:", "social security number", "Social Security No.", "Soc. Sec. #", "SSN is", "social security no.:"],
    "uk": ["NI number", "NI no.:", "National Insurance number", "NINO", "NINO:", "national insurance no."],
    "passport": ["passport", "passport no.", "Passport number", "passport:", "Reisepass", "passeport n°", "pasaporte", "travel document", "travel document no.:", "identity document"],
    "tax": ["tax ID", "tax number", "taxpayer ID:", "TIN", "Steuer-ID", "Steuernummer", "numéro fiscal", "NIF", "tax no.:", "taxpayer no.", "IdNr."],
    "nation": ["national ID", "identity card no.", "ID card", "Personalausweis", "DNI", "Aadhaar", "SIN", "SIN is", "PESEL", "BSN", "CPF", "n° de sécurité sociale", "codice fiscale", "PAN"],
}


class Maker:
    def __init__(self, seed: int, people: list[str], titles: list[str]):
        self.r = random.Random(seed)
        self.people = [p.split() for p in people if len(p.split()) == 2]
        self.titles = [t for t in titles if t.strip()]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def coined(self) -> str:
        r = self.r
        return ("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 2))) + r.choice(ENDINGS)).capitalize()

    def given(self) -> str:
        r = self.r
        x = r.random()
        return r.choice(self.people)[0] if self.people and x < 0.5 else r.choice(GIVEN) if x < 0.9 else self.coined()

    def person(self) -> str:
        r = self.r
        if self.people and r.random() < 0.5:
            g, f = r.choice(self.people)[0], r.choice(self.people)[1]
        else:
            g = r.choice(GIVEN) if r.random() < 0.8 else self.coined()
            f = r.choice(FAMILIES) if r.random() < 0.6 else self.coined()
        x = r.random()
        if x < 0.1:
            f += "-" + (r.choice(self.people)[1] if self.people and r.random() < 0.5 else r.choice(FAMILIES))
        elif x < 0.15:
            f += " " + r.choice(FAMILIES)
        if r.random() < 0.12:
            f = r.choice(["von ", "van ", "van der ", "de ", "de la ", "al ", "bin ", "Van ", "Al ", "di "]) + f
        x = r.random()
        if x < 0.13:
            g = g[0] + r.choice([".", ".", ". " + r.choice("AEGJMRS") + "."])
        elif x < 0.24:
            g += f" {r.choice('ABCDEFGHJKLMNPRSTW')}" + r.choice([".", ".", ""])
        elif x < 0.29:
            g += " " + r.choice(GIVEN)
        if r.random() < 0.13:
            f = f.upper()
        s = f"{f}, {g}" if r.random() < 0.28 else f"{f} {g}" if r.random() < 0.04 else f"{g} {f}"
        y = r.random()
        return s.lower() if y < 0.05 else s.upper() if y < 0.12 else s

    def email(self) -> str:
        r = self.r
        g, f = self.given().lower().replace(" ", ""), (r.choice(self.people)[1] if self.people and r.random() < 0.5 else self.coined()).lower()
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}.{g[0]}", f"{g[0]}{f}", f"{f}{self.digits(2)}", f"{g}{self.digits(3)}", f"{g}-{f}", f"{g}.{f}+news", "info", "sales.dept"])
        host = r.choice(["acme", "mail", "northwind", "uni-ost", "post.gov", "hr.firm", "sub.domain.site"]) + r.choice([".com", ".org", ".net", ".de", ".co.uk", ".fr", ".example", ".test", ".info"])
        s = local + r.choice(["@"] * 5 + ["(at)", " [at] ", " @ ", "[at]", " (at) "]) + host
        y = r.random()
        return s.upper() if y < 0.1 else s.title() if y < 0.15 else s

    def phone(self) -> str:
        r, d = self.r, self.digits
        a, b, c = r.choice("23456789") + d(2), d(3), d(4)
        us = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b} {c}", f"{a}{b}{c}", f"({a}){b}-{c}", f"+1{a}{b}{c}", f"{b}-{c}", f"+1 ({a}) {b}-{c}"]
        area = r.choice(["20", "121", "1632", "30", "89", "221", "40", "69"])
        two = [f"0{area} {c} {d(4)}", f"+44 {area} {c} {d(4)}", f"+44 (0){area} {d(6)}", f"0{area} {b} {d(3)}", f"0{area} {d(6)}", f"00 44 {area} {d(6)}", f"(0{area}) {d(6)}", f"+49 {area} {d(7)}", f"0{area} {d(5)} {d(3)}", f"0{area}/{d(7)}", f"(0{area}) {d(5)}-{d(3)}", f"0049/{area}/{d(8)}", f"+49 (0){area} {d(5)}-{d(3)}", f"0{area}-{d(8)}", f"+49{area}{d(8)}"]
        pairs = [f"0{r.choice('123456789')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.choice('1234567')}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33 {r.choice('123456789')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033 {r.choice('12345')} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 (0){r.choice('12345')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.choice('123456')}-{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"0{r.choice('1234567')}{d(8)}"]
        nine = r.choice("5679") + d(2)
        es = [f"{nine} {d(2)} {d(2)} {d(2)}", f"{nine}-{d(3)}-{d(3)}", f"+34 {nine} {d(3)} {d(3)}", f"{nine} {d(3)} {d(3)}", f"0034 {nine} {d(6)}", f"+34 {nine}{d(6)}", f"{nine}{d(6)}"]
        world = [f"+39 0{d(1)} {d(4)} {d(4)}", f"+91 {d(5)} {d(5)}", f"+81-{d(1)}-{d(4)}-{d(4)}", f"+61 {d(1)} {d(4)} {d(4)}", f"+{r.randint(20, 998)} {d(2)} {d(3)} {d(4)}"]
        return r.choice(r.choice([us, us, two, two, pairs, es, world]))

    def id_number(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        kind = r.choice(list(ID_LABELS))
        if kind == "us":
            s = r.choice(["-", "-", " ", ".", ""]).join([d(3), d(2), d(4)])
        elif kind == "uk":
            two = r.choice("ABCEGHJKLMNOPRSTWXYZQ") + r.choice("ABCEGHJKLMNPRSTWXYZQ")
            end = r.choice("ABCD")
            s = r.choice([f"{two}{d(6)}{end}", f"{two} {d(2)} {d(2)} {d(2)} {end}", f"{two}-{d(2)}-{d(2)}-{d(2)}-{end}", f"{two} {d(6)} {end}"])
            s = s.lower() if r.random() < 0.2 else s
        elif kind == "passport":
            one, two = r.choice("CEFGKLMPX"), r.choice("ABKLPXZ") + r.choice("ABCKLNXZ")
            s = r.choice([f"{two}{d(7)}", f"{two} {d(4)} {d(3)}", f"{one}{d(8)}", f"{one}{d(7)}", f"{two} {d(7)}", d(9)])
        elif kind == "tax":
            s = r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{d(2)}/{d(3)}/{d(5)}", f"{d(2)}-{d(7)}", d(9), f"{d(3)} {d(3)} {d(3)}"])
        else:
            s = r.choice([f"{d(8)}{r.choice('ABCDEFGHJK')}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", d(11), d(9), f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"L{d(2)}X{d(2)}T{d(2)}A", f"{r.choice('ABC')}{r.choice('KLM')}{r.choice('PQ')}P{r.choice('RST')}{d(4)}{r.choice('FGH')}"])
        return r.choice(ID_LABELS[kind]), s

    def english(self) -> str:
        r = self.r
        n = str(r.randint(1, 9999))
        n += r.choice(["", "", "", r.choice("ABCD"), f"-{r.randint(1, 30)}"])
        name = r.choice(EN_STREETS) if r.random() < 0.5 else self.coined()
        name = f"{r.choice(['N', 'W', 'S.', 'East', 'Upper', 'Old', 'Great', 'Lower', 'North', 'St.'])} {name}" if r.random() < 0.25 else f"{name} {r.choice(EN_STREETS)}" if r.random() < 0.2 else name
        s = f"{n} {name} {r.choice(EN_TYPES)}" + r.choice([""] * 9 + [" NW"])
        y = r.random()
        return s.upper() if y < 0.1 else s.lower() if y < 0.15 else s

    def german(self) -> str:
        r = self.r
        x = r.choice(["Linden", "Bahnhof", "Schiller", "Birken", "Garten", "Kirch", "Mozart", "Ost", "Hafen", self.coined()])
        name = r.choice([x + r.choice(["straße", "weg", "allee", "str.", "platz", "gasse", "ring", "damm", "ufer"]), f"{self.coined()}er {r.choice(['Str.', 'Straße', 'Allee', 'Weg', 'Platz'])}", f"{r.choice(['Am alten', 'Lange', 'Hohe', 'Breite'])} {r.choice(['Gasse', 'Straße', 'Weg'])}"])
        return f"{name} {r.randint(1, 240)}{r.choice(['', '', ' a', 'b', ' c', 'd'])}"

    def french(self) -> str:
        r = self.r
        head = r.choice(["rue", "rue", "avenue", "boulevard", "place", "chemin", "impasse", "quai", "allée", "route", "cours"])
        name = r.choice([f"{r.choice(['de la', 'du', 'des'])} {r.choice(['Gare', 'Moulin', 'Peupliers', 'Fontaine', 'Marché', 'Vignes'])}", f"de {self.coined()}", f"{r.choice(['Pasteur', 'Voltaire', 'Victor Hugo', 'Saint-Michel', 'Jean Moulin'])}", f"{r.choice(['du', 'de la', 'des'])} {self.coined()}s {self.coined()}", f"de l'{r.choice(['Église', 'Abbaye', 'Orme'])}"])
        return f"{r.randint(1, 199)}{r.choice(['', '', ' bis', ',', ' ter', ' B'])} {head} {name}"

    def spanish(self) -> str:
        r = self.r
        head = r.choice(["Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Via", "Viale", "Piazza", "Corso", "Rua"])
        name = r.choice([r.choice(["Mayor", "Goya", "Cervantes", "Roma", "Dante", "Mazzini", "Aurora"]), f"{r.choice(['del', 'de la', 'de'])} {self.coined()}", f"{self.coined()}", f"{self.coined()} {self.coined()}"])
        return f"{head} {name}{r.choice([' ', ', ', ' n.º ', ' nº '])}{r.randint(1, 240)}"

    def title(self) -> str:
        r = self.r
        if self.titles and r.random() < 0.6:
            return r.choice(self.titles)
        return " ".join(r.choice(NOUNS) for _ in range(r.randint(2, 4))) + " " + r.choice(THINGS).capitalize()

    def sentence(self, frame: str) -> tuple[str, list[tuple[str, int, int]]]:
        out, gold, i = "", [], 0
        r = self.r
        while i < len(frame):
            j = frame.find("}", i) if frame[i] == "{" else -1
            slot = frame[i + 1 : j] if j > 0 else ""
            if not slot or not slot.isalnum():
                out += frame[i]
                i += 1
                continue
            i = j + 1
            kind, text = None, ""
            if slot == "P":
                kind, text = "person", self.person()
            elif slot == "E":
                kind, text = "email", self.email()
            elif slot == "T":
                kind, text = "phone", self.phone()
            elif slot == "I":
                label, text = self.id_number()
                out += label + r.choice([" ", " ", " ", ": "] if label[-1] != ":" else [" "])
                kind = "id_number"
            elif slot in ("A", "D", "F", "S"):
                kind, text = "address", {"A": self.english, "D": self.german, "F": self.french, "S": self.spanish}[slot]()
            elif slot == "G":
                text = self.given()
            elif slot == "N":
                text = r.choice(NOUNS)
            elif slot == "t":
                text = r.choice(THINGS)
            elif slot == "R":
                text = self.title()
            elif slot[0] in "hH":
                text = "".join(r.choice("0123456789abcdef" if slot[0] == "h" else "0123456789ABCDEF") for _ in range(int(slot[1:])))
            elif slot[0] in "nd" and slot[1:].isdigit():
                text = self.digits(int(slot[1:]))
            else:
                text = r.choice(FILL[slot])
            if kind:
                gold.append((kind, len(out), len(out) + len(text)))
            out += text
        return out, gold


def frames(text: str) -> list[str]:
    return [f.replace("\\n", "\n").replace("\\t", "\t").replace("\x00", "|").replace("{{", "{").replace("}}", "}") for f in text.replace("\\|", "\x00").replace("\n", "|").split("|") if f]


def ordinary_words() -> list[str]:
    """Words written small in frames and fillers."""
    text = " ".join([*frames(FRAMES), *frames(OTHERS), *(v for k in ("w", "s", "g", "c", "v") for v in FILL[k])])
    return sorted({w for w in re.findall(r"[^\W\d_]{3,}", text) if w.islower()})


def labelled_sentences(rows: int, seed: int, people: list[str], titles: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``rows`` documents of one to four frames each, with (kind, start, end) of their personal data."""
    mk = Maker(seed, people, titles)
    with_pii, without = frames(FRAMES), frames(OTHERS)
    out = []
    for _ in range(rows):
        text, gold = "", []
        for _ in range(mk.r.randint(1, 4)):
            s, g = mk.sentence(mk.r.choice(with_pii) if mk.r.random() < 0.5 else mk.r.choice(without))
            y = mk.r.random()
            if y < 0.36 and not g:
                s = s.upper() if y < 0.22 else s.lower() if y < 0.28 else s.title()
            elif y < 0.08 and len(s.upper()) == len(s):
                s = s.upper()
            gold += [(k, a + len(text), b + len(text)) for k, a, b in g]
            text += s + mk.r.choice([" ", "\n", "\n\n", ". ", "; "])
        out.append((text, gold))
    return out
