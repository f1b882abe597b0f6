"""Seeded synthetic tickets in the knowledge-base schema.

Every draw is a hash of (seed, ticket number, slot), so a ticket does not depend
on partitioning or on any other ticket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SEED

Template = tuple[str, str, str]

TEMPLATES: Mapping[str, Sequence[Template]] = {
    "Access": (
        ("{person} cannot sign in to {tool}",
         "Since the {device} was replaced, {person} ({team}) is refused by {tool}.",
         "1. Check the entitlement of {person} for {tool}.\n2. Renew the token.\n3. Test the sign-in."),
        ("Permission missing in {tool}",
         "{team} asked for write permission in {tool}; {person} can only read.",
         "1. Compare the role matrix of {tool}.\n2. Add {person} to the {team} role."),
    ),
    "Database": (
        ("Queries on {store} are slow",
         "Reports of {team} against {store} take {count} minutes instead of seconds.",
         "1. Look for blocking sessions on {store}.\n2. Refresh the statistics."),
        ("{store} refuses connections",
         "{tool} logs that {store} has no free connection; {count} people in {team} wait.",
         "1. Free idle sessions of {tool}.\n2. Raise the pool size of {store}."),
    ),
    "Hardware": (
        ("{device} does not start",
         "The {device} of {person} in {place} stays dark after the weekend.",
         "1. Try another power supply.\n2. Replace the {device} from stock in {place}."),
        ("{device} overheats",
         "{person} reports that the {device} shuts down after {count} minutes.",
         "1. Clean the fans.\n2. Update the firmware of the {device}."),
    ),
    "Network": (
        ("Connection drops in {place}",
         "{count} people in {place} lose the connection to {tool} every hour.",
         "1. Check the uplink in {place}.\n2. Move {tool} traffic to the spare link."),
        ("{place} cannot reach {store}",
         "From {place} the host of {store} does not answer; other sites can reach it.",
         "1. Compare the routes of {place}.\n2. Correct the filter for {store}."),
    ),
    "Security": (
        ("Suspicious mail reported by {person}",
         "{person} of {team} opened a link that asked for the {tool} password.",
         "1. Reset the {tool} password of {person}.\n2. Block the sender."),
        ("Unknown {device} on the network",
         "A {device} nobody in {team} knows is connected in {place}.",
         "1. Isolate the port in {place}.\n2. Find the owner of the {device}."),
    ),
    "Software": (
        ("{tool} closes after start",
         "{tool} closes on the {device} of {person} right after the update.",
         "1. Clear the profile of {tool}.\n2. Reinstall {tool} on the {device}."),
        ("License of {tool} has run out",
         "{team} cannot open {tool}; {count} seats are reported as used.",
         "1. Release unused seats of {tool}.\n2. Order {count} more for {team}."),
    ),
}

POOLS: Mapping[str, Sequence[str]] = {
    "person": ("Alex Moreau", "Kim Tanaka", "Noor Haddad", "Robin Fischer", "Sam Okoye"),
    "team": ("Accounting", "Logistics", "Marketing", "Research"),
    "tool": ("Ledger", "Planner", "Mailroom", "Warehouse Desk", "Wiki"),
    "store": ("billing_db", "orders_db", "people_db"),
    "place": ("Lyon", "Osaka", "Porto", "Utrecht"),
    "device": ("desktop", "docking station", "laptop", "scanner"),
    "count": ("5", "12", "30"),
}

# Priority weights and the range of resolution dates.
PRIORITIES = ("P1", "P2", "P3", "P3", "P4")
FIRST_DATE, DATE_RANGE = "2024-01-01", 541


def draw(number: Column, seed: int, slot: str, size: int) -> Column:
    """A number in [0, size) fixed by (seed, ticket number, slot)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"), F.lit(slot)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def _pick(values: Sequence[str], index: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[index]


def generate_for(ids: DataFrame, number: str, seed: int = SEED,
                 templates: Mapping[str, Sequence[Template]] = TEMPLATES,
                 pools: Mapping[str, Sequence[str]] = POOLS, prefix: str = "GEN-") -> DataFrame:
    """One ticket per row of ``ids``, numbered from 1 by the column ``number``.

    Categories take turns; one value per placeholder is drawn per ticket and used
    in title, description and resolution alike.
    """
    i = F.col(number)
    categories = sorted(templates)
    turn = F.pmod(i - 1, F.lit(len(categories))).cast("int")

    def field(part: int) -> Column:
        per_category = [
            _pick([t[part] for t in templates[c]], draw(i, seed, "template", len(templates[c])))
            for c in categories]
        text = F.array(*per_category)[turn]
        for key, values in pools.items():
            text = F.replace(text, F.lit("{" + key + "}"), _pick(values, draw(i, seed, key, len(values))))
        return text

    return ids.select(
        F.format_string(f"{prefix}%05d", i).alias("ticket_id"),
        field(0).alias("title"), field(1).alias("description"), field(2).alias("resolution"),
        _pick(categories, turn).alias("category"), F.lit("Incident").alias("type"),
        _pick(PRIORITIES, draw(i, seed, "priority", len(PRIORITIES))).alias("priority"),
        F.lit("").alias("tags"),
        F.date_add(F.lit(FIRST_DATE).cast("date"), draw(i, seed, "date", DATE_RANGE)).alias("resolved_date"))


def generate_tickets(spark: SparkSession, rows: int, seed: int = SEED, **kwargs: object) -> DataFrame:
    """``rows`` synthetic tickets."""
    return generate_for(spark.range(1, rows + 1).withColumnRenamed("id", "number"), "number", seed, **kwargs)
