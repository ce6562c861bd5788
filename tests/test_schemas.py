"""Schemas parse, and a record of a nested one survives a strict round trip."""

import json

import pytest

from decispark.sources import files, schemas


@pytest.mark.parametrize("name", sorted(schemas.DDL))
def test_schema_parses(spark, name):
    assert schemas.schema(name).fieldNames()


def test_strict_transitions(spark, tmp_path):
    record = {"schema_version": "trajectory_v1", "record_type": "transition", "episode_id": "e", "step_index": 0, "game_seed": 2**64 - 1, "canonical_state": {"seed": 7, "combat": {"turn": 1, "player": {"current_hp": 5}, "hand": [{"card_id": "x", "upgrades": 1}]}}, "done": False}
    (tmp_path / "a.jsonl").write_text(json.dumps(record) + "\n" + json.dumps(record | {"schema_version": "trajectory_v2"}) + "\n")
    good, bad = files.scan_trajectories(spark, str(tmp_path / "a.jsonl"), schemas.schema("transitions"), "trajectory_v1", "transition")
    row = good.first()
    assert int(row["game_seed"]) == 2**64 - 1 and row["canonical_state"]["combat"]["hand"][0]["upgrades"] == 1
    assert [r["problem"] for r in bad.collect()] == ["schema_version"]
