"""The group map of the tournament as a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The twelve groups and their teams, as the contest lists them.
GROUPS = {
    "A": ["MEXICO", "SUDAFRICA", "COREA", "REP. CHECA"],
    "B": ["CANADA", "BOSNIA", "ESTADOS UNIDOS", "PARAGUAY"],
    "C": ["QATAR", "SUIZA", "BRASIL", "MARRUECOS"],
    "D": ["HAITI", "ESCOCIA", "AUSTRALIA", "TURQUIA"],
    "E": ["ALEMANIA", "CURAZAO", "PAISES BAJOS", "JAPON"],
    "F": ["COSTA DE MARFIL", "ECUADOR", "SUECIA", "TUNEZ"],
    "G": ["ESPAÑA", "CABO VERDE", "ARABIA SAUDITA", "URUGUAY"],
    "H": ["BELGICA", "EGIPTO", "IRAN", "NUEVA ZELANDA"],
    "I": ["FRANCIA", "SENEGAL", "IRAK", "NORUEGA"],
    "J": ["ARGENTINA", "ARGELIA", "AUSTRIA", "JORDANIA"],
    "K": ["PORTUGAL", "CONGO", "UZBEKISTAN", "COLOMBIA"],
    "L": ["INGLATERRA", "CROACIA", "GHANA", "PANAMA"],
}


def team_groups(spark: SparkSession, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Teams with their group; team_id follows the map, which breaks ties in the tables."""
    listed = [(team, grp) for grp, teams in (groups or GROUPS).items() for team in teams]
    return spark.createDataFrame(
        [(i, team, grp) for i, (team, grp) in enumerate(listed, 1)], "team_id long, team string, grp string")
