"""Secret scans: three patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, one of ordinary identifiers in four languages; both are trained
from labelled samples that training_samples() draws with a fixed seed. Runs of LEAST or more
identifier characters with a letter, with a digit or without, are scored. A run is reported as "markov" if
the mean log-likelihood ratio of its characters is above the limit of its length and it
overlaps none of the pattern matches. The limits come from labelled identifiers made of words
that the models have not seen: of each length class, the ratio that a share of QUANTILE of
them stays below, and LIMIT at least.

Defined results: a null text counts as empty and has no spans (the digest of no bytes). Rows
are independent, so ties, repeated rows and repeated ids stay as they are; an empty table
gives an empty table; other columns of any name are left out by scan() and kept by redact(),
which writes over text and, where there is such a column, n_chars. Whole texts are scanned.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

#: The base patterns and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 or more in all
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

LEAST = 16  # characters of a candidate, and of the random strings that are learned
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
ORDER = 2
LIMIT = 0.25  # nats a character
CLASSES = (16, 20, 26, 36, 52)  # least lengths that share a limit
QUANTILE = 0.999
SAMPLES = 8000  # labelled strings of each kind
HELD_OUT = 4

#: Parts that ordinary identifiers are made of, by language.
PARTS = {
    "en": """account action active address admin alias amount answer archive array attribute author balance base batch block body boolean border
bottom branch buffer build button cache call cancel category center chain change channel char check child class clean click client clock close cluster code
collect color column command comment commit config connect content context control convert copy count create current cursor custom data date debug default
delete depth detail device digest direct document domain double download driver edge edit element email enable encode engine entry error event example
export factory field file filter find first flag folder font format frame function group handle header height history home host image import index input
install item iterator join json key label language last layer layout left length level library license limit line link list load local lock login machine
manager map margin mask master match matrix memory menu merge message method minute mode model module month move name network node number object offset
option order origin output owner package page panel parent partition password path pattern
payment period permission phone picture pixel player plugin point policy port position prefix price print process product profile program project property
proxy public query queue quick quota quote random range rate record refresh region register release remote render replace reply report request reset resource
response result return role root route row rule sample save scale schedule schema scope screen script scroll search section select sender sequence server service
session setting shadow shape share sheet shell signal size socket sort source space split stack stage start state status storage store stream string style
submit subject summary support switch symbol system table target task template test text theme thread threshold time timeout title token tool total trace
track transaction transfer tree trigger type unit update upload user validate value variable vector version vertical video view visible volume warning watch weight
widget width window word work worker workspace wrapper write year zone zoom""",
    "de": """abfrage absender adresse anfrage anmeldung antwort anzahl anzeige auftrag ausgabe auswahl bearbeitung benutzer bericht beschreibung bestellung betrag
datei daten dienst drucker einstellung eingabe ereignis fehler feld fenster gesellschaft groesse grundlage hauptmann inhalt jahr kennung kennwort konto kunde
liste meldung nachricht nummer ordner pruefung quelle rechnung reihenfolge schluessel seite sicherheit speicher sprache stunde tabelle telefon uebersicht verbindung
versicherung verwaltung verzeichnis vorlage wert woche zahlung zeichen zeile zeit ziel zugriff zustand keit lich ung""",
    "fr": """accueil adresse affichage annee appel article attente bouton bureau chaine champ chemin client commande compte connexion contenu couleur courriel demande
dernier donnees dossier ecran element enregistrement entree erreur espace etat facture fenetre fichier fournisseur gestion groupe heure image jour langue
ligne liste livraison message mise modele montant navigateur niveau nombre nouveau ordre page paiement parametre personne premier produit profil question
recherche requete reseau resultat securite serveur service session sortie supprimer tableau taille telephone texte titre traitement valeur ville""",
    "es": """aplicacion archivo ayuda buscar cadena cambio campo cantidad carpeta ciudad clave cliente codigo columna conexion configuracion consulta contenido contrasena
correo cuenta datos descripcion descarga direccion documento empresa entrada envio equipo error estado etiqueta factura fecha fila formulario fuente grupo idioma
imagen informacion inicio lista llamada mensaje modelo navegador nivel nombre nuevo orden pagina pago pantalla pedido perfil persona primero producto prueba
pregunta proveedor registro respuesta resultado salida seguridad servicio servidor sesion siguiente sistema tabla tamano tarea telefono texto titulo ultimo usuario valor""",
}


def training_samples(n: int = SAMPLES, seed: int = 7, held_out: bool = False) -> tuple[list[str], list[str]]:
    """Labelled strings: random ones over the usual alphabets, and identifiers joined from PARTS; every
    HELD_OUT-th part of a language is in held-out identifiers only, and they have no others."""
    r = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-", upper + digits, lower + digits, digits + "abcdef", upper + lower, lower, upper, digits + "ABCDEF"]

    def grouped(hexes: str) -> str:
        return "-".join("".join(r.choice(hexes) for _ in range(m)) for m in (8, 4, 4, 4, 12))

    # One in eleven is grouped as in a UUID, the others run over one alphabet each.
    kinds = len(alphabets) + 1
    noise = ["".join(r.choice(alphabets[k % kinds]) for _ in range(r.randint(LEAST, 64))) if k % kinds < kinds - 1 else grouped(digits + r.choice(("abcdef", "ABCDEF"))) for k in range(n)]
    parts_of = [[w for k, w in enumerate(words.split()) if (k % HELD_OUT == 0) == held_out] for words in PARTS.values()]
    plain = []
    while len(plain) < n:
        parts = [r.choice(parts_of[len(plain) % len(parts_of)]) for _ in range(r.randint(2, 7))]
        style = r.randrange(8)
        if r.random() < 0.5:
            parts.insert(r.randint(1, len(parts)), str(r.randint(0, 10 ** r.randint(1, 4))))
        glue = ("_", "-", "/", "", "_", "", "", "-")[style]
        cased = [str.lower, str.lower, str.lower, str.capitalize, str.upper, str.lower, str.upper, str.capitalize][style]
        made = glue.join(map(cased, parts))
        if style == 5:
            made = made.capitalize() if r.random() < 0.5 else made
        if len(made) >= LEAST:
            plain.append(made)
    return noise, plain


class Markov:
    """Interpolated character model: order 2, with 1 and 0 behind it (Witten-Bell weights)."""

    def __init__(self, samples: Iterable[str]):
        self.counts: list[dict[str, dict[str, int]]] = [{} for _ in range(ORDER + 1)]
        for s in samples:
            padded = "^" * ORDER + s + "$"
            for i in range(ORDER, len(padded)):
                for k in range(ORDER + 1):
                    row = self.counts[k].setdefault(padded[i - k : i], {})
                    row[padded[i]] = row.get(padded[i], 0) + 1
        self.known: dict[str, float] = {}

    def log_p(self, context: str, c: str) -> float:
        key = context + c
        if (x := self.known.get(key)) is None:
            p = 1 / 128
            for k in range(ORDER + 1):
                row = self.counts[k].get(context[ORDER - k :], {})
                total, kinds = sum(row.values()), len(row)
                if total:
                    p = (row.get(c, 0) + kinds * p) / (total + kinds)
            x = self.known[key] = math.log(p)
        return x

    def score(self, s: str) -> float:
        padded = "^" * ORDER + s
        return sum(self.log_p(padded[i - ORDER : i], padded[i]) for i in range(ORDER, len(padded)))


class Scanner:
    def __init__(self, samples: int = SAMPLES, limit: float = LIMIT):
        noise, plain = training_samples(samples)
        self.noise, self.plain = Markov(noise), Markov(plain)
        by_class: list[list[float]] = [[] for _ in CLASSES]
        for x in training_samples(samples, seed=8, held_out=True)[1]:
            by_class[self.length_class(x)].append(self.ratio(x))
        self.limits = [max(limit, sorted(v)[min(len(v) - 1, int(len(v) * QUANTILE))]) if v else limit for v in by_class]

    @staticmethod
    def length_class(s: str) -> int:
        return max(0, bisect.bisect_right(CLASSES, len(s)) - 1)

    def random(self, s: str) -> bool:
        return self.ratio(s) > self.limits[self.length_class(s)]

    def ratio(self, s: str) -> float:
        """Mean log-likelihood ratio per character; above 0, the random model is likelier."""
        return (self.noise.score(s) - self.plain.score(s)) / max(1, len(s))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of what the patterns match, in that order."""
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The spans of the patterns; those and the models' together."""
        base = self.base(text)
        more, k, reach = [], 0, 0
        for m in RUN.finditer(text):
            while k < len(base) and base[k][0] < m.end():
                reach = max(reach, base[k][2])
                k += 1
            if reach <= m.start() and self.random(m[0]):
                more.append((m.start(), 3, m.end()))
        return base, sorted(base + more)


_scanner: dict[tuple[int, float], Scanner] = {}


def scanner(samples: int = SAMPLES, limit: float = LIMIT) -> Scanner:
    if (samples, limit) not in _scanner:
        _scanner[samples, limit] = Scanner(samples, limit)
    return _scanner[samples, limit]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@tidy
def scan_batches(batches: Iterable[pa.RecordBatch], samples: int, limit: float) -> Iterator[pa.RecordBatch]:
    s = scanner(samples, limit)
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digests, spans = [], []
        for x in batch.column("text"):
            base, every = s.spans(x.as_py() or "")
            for k in range(3):
                counts[k].append(sum(1 for b in base if b[1] == k))
            digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
            spans.append(shown(every))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, samples: int = SAMPLES, limit: float = LIMIT) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda b: scan_batches(b, samples, limit), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(s: Scanner, text: str, mark: str) -> str:
    out, at = [], 0
    for a, _, b in s.spans(text)[1]:
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark] if a >= at else []
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]", samples: int = SAMPLES, limit: float = LIMIT) -> DataFrame:
    """The same rows and columns with every span in text replaced by the mark."""
    ship(docs.sparkSession)
    schema = docs.schema

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(samples, limit)
        for batch in batches:
            arrays = list(batch.columns)
            names = batch.schema.names
            k = names.index("text")
            new = [None if x is None else redacted(s, x, mark) for x in arrays[k].to_pylist()]
            arrays[k] = pa.array(new, batch.schema.field(k).type)
            if "n_chars" in names:
                j = names.index("n_chars")
                arrays[j] = pa.array([o if t is None else len(t) for t, o in zip(new, arrays[j].to_pylist(), strict=True)], batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(rows, schema)
