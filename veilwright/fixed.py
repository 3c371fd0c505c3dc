"""Word lists, patterns, formats and constants that results depend on, stated as they are."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------------------------------------

TEXT_EXTENSIONS = (".cbl", ".cob", ".cobol", ".cpy", ".jcl", ".proc", ".txt", ".csv", ".json", ".xml", ".md", ".log", ".sql", ".dat", ".ctl")

#: Which entity stays where findings overlap.
PRIORITY = {"CODICE_FISCALE": 100, "IBAN": 95, "EMAIL": 90, "MATRICOLA": 80, "SUSPECTED_MATRICOLA": 79, "PHONE": 75, "NAME": 60}
#: The order of entities in reports.
REPORT_ORDER = {"NAME": 10, "MATRICOLA": 20, "SUSPECTED_MATRICOLA": 21, "IBAN": 30, "CODICE_FISCALE": 40, "EMAIL": 50, "PHONE": 60}
NON_LINKABLE = ("NAME", "MATRICOLA", "SUSPECTED_MATRICOLA")
CONTEXT_RADIUS = 75
SHOWN_LOCATIONS = 8

EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
CODICE_FISCALE = r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b"
MATRICOLA_VALUE = r"[567]?\d{6}"
MATRICOLA_LABELS = ("MATRICOLA", "MATR", "CODDIP", "COD-DIP", "CODICE-DIP", "CODICE-DIPENDENTE", "DIPENDENTE", "EMPLOYEE-ID", "EMP-ID")
PHONE_LABELS = ("TEL", "TELEFONO", "PHONE", "CELL", "CELLULARE")
PHONE_VALUE = r"\+?\d[\d .()/-]{6,20}\d"
UPPER_NAME_TOKEN = r"(?<![\w'])[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’]{2,}(?![\w'])"
ROSTER_TOKEN = r"[^\W\d_][^\W\d_'-]*"
QUOTED = r"'[^'\r\n]{2,160}'|\"[^\"\r\n]{2,160}\""
NAME_EDGES = " \t\r\n.,;:()[]{}\"'"
ADDRESS_STOPS = "\"'<>(),;"

NAME_LINE_MARKERS = (" AUTHOR", "DISPLAY ", " VALUE ", " STRING ", " ASSIGN TO ", " NOME", "COGNOME", "NOMINATIVO", "REFERENTE", "RESPONSABILE", "OPERATORE", "ANALISTA", "CONTATTARE")
UNKNOWN_NAME_PREFIXES = ("PDR", "PDH", "PDC", "SQL", "DFH", "CICS")
COMMON_ENDINGS = ("MENTO", "ZIONE", "GRAFICA", "ABILE", "ATORI", "AZIONE")

#: Labels before names; never part of one.
NAME_STOPWORDS = tuple("""
    AUTHOR CELL CELLULARE CODICE COGNOME COMMENTO EMAIL FISCALE IBAN MAIL MATRICOLA NOME NOMINATIVO OPERATORE
    REFERENTE RESPONSABILE TEL TELEFONO TEST
""".split())

#: Upper-case words of legacy sources that are no surnames, besides the labels.
UNKNOWN_NAME_STOPWORDS = tuple("""
    ABEND ACCT AGGIORNAMENTO AGGIORNARE AGGIORNATA AGGIUNTA ALLA ANAGRAFICA ANNOTAZIONE APPOGGIO AREA ASSEGNI
    ASSIGN ATTENZIONE BATCH BREVE CALL CATALOGO CATEGORIE CATEGORIEPARTICOLARI CEDOLINO CESSATI CESSAZIONE CODICE
    COMMENT COMPOSTO COMP CONGUAGLIO CONTABILI CONTROLLO COPY COPYBOOK CREATE CREATED DATA DATI DEBITO DELLA DELLE
    DIREZIONE DISPLAY DIVISION DOPO ELENCO ELIMINAZIONE ERRORE EXEC FILE GESTIONE IMPOSTA INPUT LABEL LAVORAZIONE
    MAGGIORE MATCH MODIFICA MODIFICHE NON NOMINATIVI NOTE OUTPUT PARM PIC PROGRAM PROGRAMMA PROCEDURE PUNTAMENTO
    RECORD RIATTIVATI RIGA RIGHE RIVERSIBILITA RIVERSIB SCRITTURA SENZA SPACES STAMPA STOP TABELLA VALUE VALIDATO
    VALIDATA VALIDAZIONE VERIFICARE VERIFICA VITALIZI WORKING WURTH ZERO ZEROS
""".split())

#: Words on a line that make a surname likely.
NAME_CONTEXT_WORDS = tuple("""
    AGGIORNATO ANALISTA AUTORE AUTHOR AVVISARE CHIAMARE CONTATTARE CREATO EMAIL REFERENTE RESPONSABILE MAIL OPERATORE
    SEGNALARE SIG SIG. SIGRA SIG.RA UTENTE
""".split())

#: Language keywords that a recognizer takes for names.
TECHNICAL_WORDS = tuple("""
    CALL COMP DISPLAY DIVISION ELSE END IF MOVE PERFORM PIC SECTION THEN TO USING VALUE WHEN
""".split())

#: Column names in rosters.
ROSTER_STOPWORDS = tuple("ID EMPLOYEE EMPLOYEEID MATR MATRICOLA NAME NOME COGNOME SURNAME FIRSTNAME LASTNAME".split())

#: Weights of letters (and of digits, which count as the letters A to J) at odd places of an Italian tax code.
TAX_CODE_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)

FINDING_FIELDS = ("file", "entity_type", "text", "line", "column", "confidence", "context", "source")
NAME_FIELDS = ("name", "folder", "file", "line", "column", "confidence", "source", "context")
MAP_FIELDS = ("entity_type", "key", "original", "suggested_replacement", "replacement", "hits", "locations")

#: Command-line flags with their defaults; ``list``: may be given several times, ``switch``: takes no value.
FLAGS = (
    ("--out-dir", "text", None),
    ("--report-dir", "text", None),
    ("--entities", "entities", None),
    ("--name-scope", "scope", "context"),
    ("--watchlist", "list", ()),
    ("--employee-roster", "list", ()),
    ("--default-name-watchlist", "text", None),
    ("--no-default-name-watchlist", "switch", False),
    ("--detect-unknown-names", "switch", False),
    ("--unknown-name-min-length", "number", 4),
    ("--names-only", "switch", False),
    ("--no-presidio", "switch", False),
    ("--presidio-model", "text", "it_core_news_sm"),
    ("--create-map", "text", None),
    ("--map-file", "text", None),
    ("--scan-only", "switch", False),
    ("--auto", "switch", False),
    ("--salt", "text", None),
)
SCOPES = ("context", "all")
