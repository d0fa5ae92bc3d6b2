"""Court vocabulary: binding force, epochs, circuits, court presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import fold

# Fixed values -------------------------------------------------------------
SUPREME_COURT = "Suprema Corte de Justicia de la Nación"

EPOCHS = (
    "Primera Época", "Segunda Época", "Tercera Época", "Cuarta Época",
    "Quinta Época", "Sexta Época", "Séptima Época", "Octava Época",
    "Novena Época", "Décima Época", "Undécima Época", "Duodécima Época",
)

UNIT_ORDINALS = (
    "primer", "segundo", "tercer", "cuarto", "quinto",
    "sexto", "septimo", "octavo", "noveno",
)
TEN_ORDINALS = ("decimo", "vigesimo", "trigesimo")

ROMANS = (
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x",
    "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx",
    "xxi", "xxii", "xxiii", "xxiv", "xxv", "xxvi", "xxvii", "xxviii", "xxix", "xxx",
    "xxxi", "xxxii",
)
CIRCUITS = 32
# --------------------------------------------------------------------------

LEVELS = ("S", "A", "B", "C", "D", "E", "F")


def _literal_map(entries: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _ordinal_numbers() -> dict[str, int]:
    """Ordinals written without blanks; "decimoctavo" may drop its doubled vowel."""
    units = {word: n for n, word in enumerate(UNIT_ORDINALS, 1)}
    numbers = dict(units)
    for ten, word in enumerate(TEN_ORDINALS, 1):
        numbers[word] = 10 * ten
        for unit, n in units.items():
            if 10 * ten + n <= CIRCUITS:
                numbers[word + unit] = 10 * ten + n
                if unit.startswith("o"):
                    numbers[word[:-1] + unit] = 10 * ten + n
    return numbers


ORDINAL_NUMBERS = _ordinal_numbers()
ROMAN_NUMBERS = {word: n for n, word in enumerate(ROMANS, 1)}
_TENS = "|".join(TEN_ORDINALS)
_UNITS = "|".join(UNIT_ORDINALS)
_ELIDED = "|".join(t[:-1] + "octavo" for t in TEN_ORDINALS)
ORDINAL = f"(?:{_ELIDED}|(?:{_TENS}) ?(?:{_UNITS})|{_TENS}|{_UNITS})"


# -- binding force ----------------------------------------------------------

def is_binding(kind: Column) -> Column:
    return F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("jurisprudencia"))


def _is_supreme(court: Column) -> Column:
    return F.coalesce(court == SUPREME_COURT, F.lit(False))


def _organ_starts(organ: Column, prefix: str) -> Column:
    return F.startswith(F.lower(F.coalesce(organ, F.lit(""))), F.lit(prefix))


def _has(c: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(part))


def binding_bucket(court: Column, organ: Column) -> Column:
    """0 plenary, 1 chamber, 2 regional, 3 circuit plenary, 4 collegiate, 5 other."""
    return (
        F.when(_is_supreme(court) & _organ_starts(organ, "pleno"), 0)
        .when(_is_supreme(court) & _has(organ, "sala"), 1)
        .when(_has(court, "plenos regionales"), 2)
        .when(_has(court, "plenos de circuito"), 3)
        .when(_has(court, "tribunales colegiados"), 4)
        .otherwise(5)
    )


def binding_level(kind: Column, court: Column, organ: Column) -> Column:
    """S to D for binding criteria, E and F for isolated ones."""
    bucket = binding_bucket(court, organ)
    binding = F.element_at(F.array(*[F.lit(x) for x in "SABCDD"]), bucket + 1)
    isolated = F.when(_is_supreme(court), "E").otherwise("F")
    return F.when(is_binding(kind), binding).otherwise(isolated)


# -- court presets ----------------------------------------------------------

def court_presets(court: Column, organ: Column) -> dict[str, Column]:
    """Preset name to predicate; the names and their texts are fixed values."""
    supreme = court == SUPREME_COURT
    return {
        "scjn": supreme,
        "pleno_scjn": supreme & _organ_starts(organ, "pleno"),
        "salas_scjn": supreme & _has(organ, "sala"),
        "primera_sala": supreme & _organ_starts(organ, "primera sala"),
        "segunda_sala": supreme & _organ_starts(organ, "segunda sala"),
        "plenos_regionales": _has(court, "plenos regionales"),
        "plenos_circuito": _has(court, "plenos de circuito"),
        "tcc": _has(court, "tribunales colegiados"),
    }


PRESETS = (
    "scjn", "pleno_scjn", "salas_scjn", "primera_sala", "segunda_sala",
    "plenos_regionales", "plenos_circuito", "tcc",
)


# -- epochs and circuits ----------------------------------------------------

def normalize_epoch(c: Column) -> Column:
    """Word, number or Roman numeral to the canonical name, else NULL."""
    words = {fold_ascii(name.split()[0]): name for name in EPOCHS}
    digits = {str(n): name for n, name in enumerate(EPOCHS, 1)}
    romans = {ROMANS[n]: name for n, name in enumerate(EPOCHS)}
    key = F.trim(F.replace(fold(c), F.lit("epoca"), F.lit("")))
    return F.try_element_at(_literal_map({**words, **digits, **romans}), key)


def fold_ascii(word: str) -> str:
    """Accent folding for the few fixed Spanish words above."""
    return word.lower().translate(str.maketrans("áéíóú", "aeiou"))


def _circuit_number(ordinal: Column) -> Column:
    joined = F.replace(ordinal, F.lit(" "), F.lit(""))
    return F.try_element_at(_literal_map(ORDINAL_NUMBERS), joined)


def parse_circuit(c: Column) -> Column:
    """1 to 32 from digits, a Roman numeral or a Spanish ordinal, else NULL.

    The longest known ordinal at the start counts: "trigesimo quinto" reads as 30.
    """
    text = fold(F.trim(c.cast("string")))
    digits = F.when(text.rlike(r"^[0-9]+$"), text.try_cast("int"))
    number = F.coalesce(
        digits,
        F.try_element_at(_literal_map(ROMAN_NUMBERS), text),
        _circuit_number(F.regexp_extract(text, f"^{ORDINAL}", 0)),
        _circuit_number(F.regexp_extract(text, f"^(?:{_TENS})", 0)),
    )
    return F.when(number.between(1, CIRCUITS), number)


def circuit_of_court(organ: Column) -> Column:
    """Circuit named in an organ's title, read from the words right before "circuito"."""
    text = fold(F.coalesce(organ, F.lit("")))
    ordinal = F.regexp_extract(text, rf"\b({ORDINAL}) circuito", 1)
    roman = F.regexp_extract(text, r"\b([ivx]+)[.]? circuito", 1)
    return F.coalesce(
        _circuit_number(ordinal), F.try_element_at(_literal_map(ROMAN_NUMBERS), roman)
    )


def binds_circuit(kind: Column, court: Column, organ: Column, circuit: Column) -> Column:
    """Binding, and from a court whose criteria reach that circuit."""
    local = _has(court, "plenos de circuito") | _has(court, "tribunales colegiados")
    reaches = (
        _is_supreme(court)
        | _has(court, "plenos regionales")
        | (local & F.coalesce(circuit_of_court(organ) == circuit, F.lit(False)))
    )
    return is_binding(kind) & reaches
