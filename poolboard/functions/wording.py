"""Texts, marks, sizes and names that results must carry as they are."""

# The three outcomes of a match (home, draw, away).
OUTCOMES = ("1", "X", "2")
OUTCOME_WORDS = {"1": "Local", "X": "Empate", "2": "Visitante"}
OUTCOME_LETTERS = {"1": "L", "X": "E", "2": "V"}
DISTRIBUTION_NAMES = {"1": "Local (1)", "X": "Empate (X)", "2": "Visitante (2)"}

# Match status list and contest size.
STATUSES = ("pending", "in_progress", "finished")
CONTEST_SIZE = 72

# Status line of a match.
FINAL_PREFIX = "Resultado final: "
LIVE_PREFIX = "En desarrollo: "
NOT_STARTED = "Pendiente"

# Header of the blank sheet, in column order.
SHEET_HEADER = ("#", "Fecha", "Hora", "Día", "Gana Local", "Local", "Empate", "Visitante", "Gana Visitante")

# Messages of the sheet import.
ROW_MANY_MARKS = "Fila #{}: tiene más de una X marcada"
ROW_NO_PICK = "Fila #{}: sin pronóstico"
ROW_UNKNOWN_MATCH = "Fila #{}: partido no encontrado"
SHEET_ERRORS_HEAD = "Errores:\n"
SHEET_ERRORS_MORE = "\n...y {} más"
SHEET_WRONG_SIZE = "Se encontraron {} pronósticos válidos, se necesitan 72."
SHEET_ERRORS_SHOWN = 10

# The notification for a finished match.
FINISH_TITLE = "🏁 Finalizó #{}"
FINISH_SCORE = "⚽ {} {} - {} {}"
FINISH_RESULT = "Resultado: {}"
FINISH_HIT = "✅ ¡Acertaste!"
FINISH_MISS = "❌ No acertaste"
FINISH_POSITION = "📊 Posición: {}°"
FINISH_UP = " (subiste {} 🔼)"
FINISH_DOWN = " (bajaste {} 🔽)"
FINISH_URL = "/partidos"

# Weekday names, Sunday first (the numbering of ``dayofweek``).
WEEKDAYS = ("Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado")
