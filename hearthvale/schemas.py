"""The 48-table village schema: column types and declared constraints.

Constraints are not enforced by Parquet; they become a bulk audit
(``hearthvale.operators.audit``). Column spec mini-language, one line per
table: ``name type [!] [len=n]`` separated by ``;`` — ``!`` is NOT NULL,
``string(n)`` a bounded VARCHAR2. Keys/checks follow in the table entry.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "money": T.DecimalType(18, 2),
    "dec10": T.DecimalType(10, 2), "dec5": T.DecimalType(5, 2), "ts": T.TimestampNTZType(),
    "string": T.StringType(),
}


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[tuple[str, str, bool, int | None], ...]   # (name, type, not_null, max_len)
    pk: tuple[str, ...]
    fks: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()                  # (rule name, SQL boolean expression)
    cascade: tuple[str, ...] = field(default=())              # parents whose delete cascades here

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, _TYPES[t], not nn) for c, t, nn, _ in self.columns])


def _cols(spec: str):
    out = []
    for part in spec.split(";"):
        bits = part.split()
        name, typ = bits[0], bits[1]
        n = None
        if typ.startswith("string("):
            n = int(typ[7:-1])
            typ = "string"
        out.append((name, typ, "!" in bits[2:], n))
    return tuple(out)


def _fk(child: str, parent: str, pcols: str | None = None):
    c = tuple(child.split(","))
    return (c, parent, tuple((pcols or child).split(",")))


# The declared tables, columns, keys and checks.
TABLES: dict[str, Table] = {t.name: t for t in [
    Table("village", _cols("id_village long !; name string(100) !"), ("id_village",)),
    Table("character", _cols("id_character long !; name string(100) !; age long; gender string(20); id_village long"),
          ("id_character",), (_fk("id_village", "village"),)),
    Table("relationship", _cols("id_relationship long !; id_character1 long !; id_character2 long !; "
                                "affection_level long !; type_relation string(30)"),
          ("id_relationship",),
          (_fk("id_character1", "character", "id_character"), _fk("id_character2", "character", "id_character")),
          unique=(("id_character1", "id_character2"),),
          checks=(("ck_rel_not_self", "id_character1 <> id_character2"),)),
    Table("inhabitant", _cols("id_inhabitant long !; personality string(200); birthday ts; sprite string(200); "
                              "appearence string(200)"),
          ("id_inhabitant",), (_fk("id_inhabitant", "character", "id_character"),)),
    Table("dialogue", _cols("id_dialogue long !; id_inhabitant long !; content string(200) !; skippable string(5) !"),
          ("id_dialogue",), (_fk("id_inhabitant", "inhabitant"),)),
    Table("schedule", _cols("id_schedule long !; season string(20); start_time string(5); end_time string(5); "
                            "day_of_week string(10)"), ("id_schedule",)),
    Table("place", _cols("id_place long !; location_name string(200); coordinates string(50)"), ("id_place",)),
    Table("building", _cols("id_building long !; name_building string(100); description string(250); id_place long"),
          ("id_building",), (_fk("id_place", "place"),)),
    Table("has", _cols("id_inhabitant long !; id_place long !; id_schedule long !"),
          ("id_inhabitant", "id_place", "id_schedule"),
          (_fk("id_inhabitant", "inhabitant"), _fk("id_place", "place"), _fk("id_schedule", "schedule"))),
    Table("item", _cols("id_item long !; name string(100) !; description string(250); price_to_buy money; "
                        "price_to_sell money"), ("id_item",)),
    Table("player", _cols("id_player long !; avatar_appearance string(100); nickname string(50); gold money; "
                          "experience long; skill_level long; skill string(100)"),
          ("id_player",), (_fk("id_player", "character", "id_character"),)),
    Table("mission", _cols("id_mission long !; name string(100); description string(500)"), ("id_mission",)),
    Table("player_mission", _cols("id_player long !; id_mission long !; start_date ts; end_date ts; is_completed int"),
          ("id_player", "id_mission"), (_fk("id_player", "player"), _fk("id_mission", "mission")),
          checks=(("ck_pm_completed", "is_completed IN (0, 1)"),)),
    Table("letter", _cols("id_letter long !; content string(200); font string(100); id_item long; id_mission long"),
          ("id_letter",), (_fk("id_item", "item"), _fk("id_mission", "mission"))),
    Table("food", _cols("id_food long !; ingredients string(200); energy_regain long; health_regain long"),
          ("id_food",), (_fk("id_food", "item", "id_item"),)),
    Table("seed", _cols("id_seed long !; seed_type string(100); name_crop string(100)"),
          ("id_seed",), (_fk("id_seed", "item", "id_item"),)),
    Table("supply", _cols("id_supply long !; nutritional_value int; nutritional_qualities string(50)"),
          ("id_supply",), (_fk("id_supply", "item", "id_item"),)),
    Table("animal_specie", _cols("id_animal_specie long !; specie_name string(100)"), ("id_animal_specie",)),
    Table("feed", _cols("id_supply long !; id_animal_specie long !"), ("id_supply", "id_animal_specie"),
          (_fk("id_supply", "supply"), _fk("id_animal_specie", "animal_specie"))),
    Table("p_stored", _cols("id_player long !; id_item long !; quantity long"), ("id_player", "id_item"),
          (_fk("id_player", "player"), _fk("id_item", "item"))),
    Table("farm", _cols("id_farm long !; hectares dec10; specialization string(100); id_player long"),
          ("id_farm",), (_fk("id_farm", "building", "id_building"), _fk("id_player", "player"))),
    Table("farmbuilding", _cols("id_farm_building long !; name_building string(100); description string(250); "
                                "building_size dec10; id_farm long"),
          ("id_farm_building",), (_fk("id_farm", "farm"),)),
    Table("barn", _cols("id_barn long !; max_capacity long; occupied_spots long"),
          ("id_barn",), (_fk("id_barn", "farmbuilding", "id_farm_building"),)),
    Table("animal", _cols("id_animal long !; name_animal string(100); age long; id_animal_specie long; "
                          "health string(50); id_barn long; quantity long"),
          ("id_animal",), (_fk("id_barn", "barn"), _fk("id_animal_specie", "animal_specie"))),
    Table("product", _cols("id_product long !; name_product string(100); id_animal_specie long"),
          ("id_product",), (_fk("id_animal_specie", "animal_specie"),)),
    Table("produce", _cols("id_animal long !; id_product long !; production_date ts; expiration_date ts; "
                           "quality string(50)"),
          ("id_animal", "id_product"), (_fk("id_animal", "animal"), _fk("id_product", "product"))),
    Table("cultivationfield", _cols("id_field long !; cost dec10; state string(100)"),
          ("id_field",), (_fk("id_field", "farmbuilding", "id_farm_building"),)),
    Table("crop", _cols("id_crop long !; name_crop string(100); growing_season string(100); growth_duration long; "
                        "quality string(100)"), ("id_crop",)),
    Table("grow", _cols("id_field long !; id_crop long !"), ("id_field", "id_crop"),
          (_fk("id_field", "cultivationfield"), _fk("id_crop", "crop"))),
    Table("receive", _cols("id_inhabitant long !; id_player long !; id_letter long !; emotion string(200)"),
          ("id_inhabitant", "id_player", "id_letter"),
          (_fk("id_inhabitant", "inhabitant"), _fk("id_player", "player"), _fk("id_letter", "letter"))),
    Table("shop", _cols("id_shop long !; name_shop string(100); id_place long; specialization string(50); "
                        "description string(100)"), ("id_shop",), (_fk("id_place", "place"),)),
    Table("follow", _cols("id_shop long !; id_schedule long !"), ("id_shop", "id_schedule"),
          (_fk("id_shop", "shop"), _fk("id_schedule", "schedule")), cascade=("shop", "schedule")),
    Table("s_stored", _cols("id_shop long !; id_item long !; quantity long"), ("id_shop", "id_item"),
          (_fk("id_shop", "shop"), _fk("id_item", "item"))),
    Table("buy_sell", _cols("id_shop long !; id_player long !; id_item long !; action_time ts !; action string(10); "
                            "money_fluctuation money; amount long"),
          ("id_shop", "id_player", "id_item", "action_time"),
          (_fk("id_shop", "shop"), _fk("id_player", "player"), _fk("id_item", "item")),
          checks=(("ck_bs_action", "action IN ('BUY', 'SELL')"),)),
    Table("festivity", _cols("id_festivity long !; name_festivity string(100); is_completed string(5)"),
          ("id_festivity",), checks=(("ck_fest_completed", "is_completed IN ('TRUE', 'FALSE')"),)),
    Table("activity", _cols("id_activity long !; name_activity string(100); description string(250); duration long; "
                            "id_festivity long"), ("id_activity",), (_fk("id_festivity", "festivity"),)),
    Table("compose", _cols("id_activity long !; id_festivity long !"), ("id_activity", "id_festivity"),
          (_fk("id_activity", "activity"), _fk("id_festivity", "festivity"))),
    Table("specialitem", _cols("id_specialitem long !"), ("id_specialitem",)),
    Table("participate", _cols("id_activity long !; id_player long !; id_specialitem long !"),
          ("id_activity", "id_player", "id_specialitem"),
          (_fk("id_activity", "activity"), _fk("id_player", "player"), _fk("id_specialitem", "specialitem"))),
    Table("sell", _cols("id_festivity long !; id_shop long !; discount dec5"), ("id_festivity", "id_shop"),
          (_fk("id_festivity", "festivity"), _fk("id_shop", "shop"))),
    Table("event", _cols("id_event long !; start_time string(5); end_time string(5); description string(250); "
                         "id_place long"), ("id_event",), (_fk("id_place", "place"),)),
    Table("happen", _cols("id_event long !; id_place long !"), ("id_event", "id_place"),
          (_fk("id_event", "event"), _fk("id_place", "place"))),
    Table("residentevent", _cols("id_residentevent long !; id_resident long; id_player long"),
          ("id_residentevent",),
          (_fk("id_resident", "inhabitant", "id_inhabitant"), _fk("id_player", "player"))),
    Table("museum", _cols("id_museum long !; completion dec5; id_village long"), ("id_museum",),
          (_fk("id_village", "village"),)),
    Table("donatable", _cols("id_donatable long !"), ("id_donatable",)),
    Table("book", _cols("id_book long !; title string(200); num_pages long"), ("id_book",),
          (_fk("id_book", "donatable", "id_donatable"),)),
    Table("mineral", _cols("id_mineral long !; quality string(100); rarity string(100)"), ("id_mineral",),
          (_fk("id_mineral", "donatable", "id_donatable"),)),
    Table("donation", _cols("id_donatable long !; id_museum long !; id_player long !; condition_object string(100)"),
          ("id_donatable", "id_museum", "id_player"),
          (_fk("id_donatable", "donatable"), _fk("id_museum", "museum"), _fk("id_player", "player"))),
]}
