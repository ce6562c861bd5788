"""Schemas of the tables that the operators read, as Spark DDL; nothing is inferred from data.

Seeds are unsigned 64-bit numbers and so DECIMAL(20,0). Free JSON stays a string.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of the record formats.
CARD = "STRUCT<card_id:STRING,name:STRING,card_type:STRING,cost:INT,upgrades:INT,description:STRING,exhausts:BOOLEAN,ethereal:BOOLEAN,has_target:BOOLEAN,is_playable:BOOLEAN,uuid:STRING,special_data:INT>"
POWER = f"STRUCT<power_id:STRING,name:STRING,amount:INT,damage:INT,misc:INT,just_applied:BOOLEAN,card:{CARD}>"
BEHAVIOR = "STRUCT<phase:STRING,previous_move_id:INT,possible_next_move_ids:ARRAY<INT>,selection:STRING,rule:STRING>"
MONSTER = f"STRUCT<monster_id:STRING,name:STRING,current_hp:INT,max_hp:INT,block:INT,intent:STRING,move_id:INT,move_hits:INT,move_base_damage:INT,move_adjusted_damage:INT,powers:ARRAY<{POWER}>,is_gone:BOOLEAN,half_dead:BOOLEAN,behavior:{BEHAVIOR},stasis_card:{CARD}>"
PLAYER = f"STRUCT<current_hp:INT,max_hp:INT,block:INT,energy:INT,powers:ARRAY<{POWER}>>"
ACCOUNTING = "STRUCT<starting_hp:INT,enemy_damage_taken:INT,self_hp_loss:INT>"
PILES = ",".join(f"{name}:ARRAY<{CARD}>" for name in ("hand", "draw_pile", "discard_pile", "exhaust_pile"))
COMBAT = f"STRUCT<turn:INT,player:{PLAYER},monsters:ARRAY<{MONSTER}>,{PILES},accounting:{ACCOUNTING}>"
RELIC = "STRUCT<relic_id:STRING,name:STRING,counter:INT>"
STATE = f"STRUCT<seed:DECIMAL(20,0),character:STRING,ascension_level:INT,act:INT,floor:INT,combat:{COMBAT},relics:ARRAY<{RELIC}>,known_draw_top:ARRAY<{CARD}>,hand_upgrade_previews:ARRAY<{CARD}>>"
ACTION = "STRUCT<action_id:STRING,action_type:STRING,hand_index:INT,card_uuid:STRING,card_name:STRING,target_index:INT>"
ACTION_CLASS = "STRUCT<model_action_id:STRING,action_type:STRING,card_name:STRING,target_index:INT,copies:INT,equivalent_internal_action_ids:ARRAY<STRING>,representative_internal_action_id:STRING>"
POLICY_RESULT = f"STRUCT<action:{ACTION},decision_source:STRING,selected_model_action_id:STRING,equivalent_internal_action_ids:ARRAY<STRING>,raw_output:STRING,parsed_action_id:STRING,parse_success:BOOLEAN,legal_on_first_attempt:BOOLEAN,retry_used:BOOLEAN,retry_raw_output:STRING,retry_parsed_action_id:STRING,retry_success:BOOLEAN,fallback_used:BOOLEAN,inference_ms:DOUBLE>"
LINEAGE = "STRUCT<source_route_id:STRING,route_index:INT,combat_seed_group_index:INT,run_id:STRING,arm:STRING,combat_index:INT>"
SAMPLE = "STRUCT<id:STRING,route:INT,`group`:INT,combat:INT,step:INT>"
SOURCE = f"STRUCT<sample:{SAMPLE},encounter_family:STRING>"
MODEL_ACTION = "STRUCT<model_action_id:STRING,action_type:STRING,card_name:STRING,target:INT>"
EDGE = "STRUCT<chosen_action_id:STRING,rejected_action_id:STRING,mean_carried_hp_gap:DOUBLE,paired_standard_error:DOUBLE,paired_trials:INT,weight:DOUBLE>"
DATASET = f"schema_version STRING, dataset_id STRING, record_id STRING, split STRING, observation_version STRING, observation STRING, observation_sha256 STRING, model_actions ARRAY<{MODEL_ACTION}>, source {SOURCE}"
RATES = ", ".join(f"{kind}_pick_rate_f{act} DOUBLE" for kind in ("first", "duplicate") for act in (1, 2, 3))

DDL = {
    "trials": "sample_id STRING NOT NULL, trial INT NOT NULL, root_action STRING NOT NULL, outcome STRING NOT NULL, ending_hp INT, max_hp INT, relic_counters ARRAY<STRUCT<id:STRING,counter:INT>>, decisions INT, search_calls INT, elapsed_seconds DOUBLE",
    "states": f"sample {SAMPLE}, status STRING, encounter_family STRING, outer_trials_completed INT, minimum_win_rate DECIMAL(20,18), win_floor_rounding STRING, minimum_wins INT, executions INT, executed_decisions INT, observation STRING, estimated_acceptable_actions ARRAY<STRING>",
    "root_actions": "sample_id STRING, id STRING, card STRING, target INT, action_type STRING, card_semantics STRUCT<card_id:STRING,card_type:STRING,upgrades:INT>",
    "action_stats": "sample_id STRING, action STRING, trials INT, wins INT, win_rate DOUBLE, win_rate_lcb_simultaneous DOUBLE, passes_win_floor BOOLEAN, passes_win_floor_lcb BOOLEAN, expected_carried_hp DOUBLE, victory_hp_mean DOUBLE",
    "pair_stats": "sample_id STRING, a STRING, b STRING, paired_trials INT, mean_carried_hp_a_minus_b DOUBLE, standard_error DOUBLE, unpriced_resource_conflict_trials INT",
    "transitions": f"schema_version STRING NOT NULL, record_type STRING NOT NULL, logged_at_utc STRING, episode_id STRING NOT NULL, step_index INT NOT NULL, game_seed DECIMAL(20,0), policy_seed DECIMAL(20,0), policy_name STRING, encounter STRING, scenario_id STRING, turn INT, raw_state STRING, canonical_state {STATE}, serialized_state STRING, legal_actions ARRAY<{ACTION}>, model_legal_actions ARRAY<{ACTION_CLASS}>, action {ACTION}, policy_result {POLICY_RESULT}, reward DOUBLE, score DOUBLE, next_raw_state STRING, next_canonical_state {STATE}, done BOOLEAN, terminal_outcome STRING, route_lineage {LINEAGE}, route_done BOOLEAN, route_terminal_outcome STRING",
    "rates": f"enum_id STRING NOT NULL, source_card_id STRING, card_name STRING, upgraded BOOLEAN NOT NULL, color STRING, rarity STRING, card_type STRING, min_ascension INT, found BOOLEAN, pick_rate DOUBLE, {RATES}, sample_players INT, sample_size INT, generated_time STRING",
    "supervised": f"{DATASET}, candidates ARRAY<STRUCT<action_id:STRING,weight:DOUBLE>>, supervision_source STRING, loss_weight DOUBLE",
    "preferences": f"{DATASET}, edges ARRAY<{EDGE}>, loss_weight DOUBLE",
    "search_actions": "decision_id INT, action_id STRING, kind STRING, visits INT, evaluation_sum DOUBLE, evaluation_square_sum DOUBLE, mean_evaluation DOUBLE, terminal_wins INT, terminal_losses INT, win_rate DOUBLE, ending_hp_sum INT, ending_hp_mean DOUBLE, victory_ending_hp_sum INT, victory_ending_hp_mean DOUBLE",
    "episodes": "episode_index INT, scenario_id STRING, ascension INT, combat_seed DECIMAL(20,0), outcome STRING, decisions INT, turns INT, starting_hp INT, ending_hp INT, total_hp_loss INT, enemy_damage_taken INT, self_hp_loss INT, accounting_consistent BOOLEAN, protocol STRUCT<retry_count:INT,fallback_count:INT,first_pass_legal_count:INT,inference_ms_total:DOUBLE>",
    "combats": "arm STRING, route_index INT, combat_seed_group_index INT, combat_index INT, floor INT, encounter_family STRING, scenario_id STRING, combat_seed DECIMAL(20,0), policy_seed DECIMAL(20,0), outcome STRING, decisions INT, turns INT, starting_hp INT, ending_hp INT, max_hp INT, total_hp_loss INT, relics ARRAY<STRUCT<id:STRING,counter:INT>>, trajectory STRING, trajectory_sha256 STRING",
    "routes": "arm STRING, route_index INT, combat_seed_group_index INT, status STRING, combats_started INT, combats_won INT, death_combat_index INT",
    "route_steps": "route_index INT, position INT, kind STRING, act INT, checkpoint STRING, combat_index INT, floor INT, encounter_family STRING, scenario_id STRING, room STRING, relic_id STRING, amount INT, combat_seed DECIMAL(20,0), policy_seed DECIMAL(20,0)",
    "parity_fixtures": f"schema_version STRING, fixture_id STRING, step_index INT, encounter STRING, execution STRUCT<status:STRING,blockers:ARRAY<STRING>,simulator_reset:STRING>, canonical_input {STATE}, chosen_action {ACTION}, expected_next STRING, real_raw_snapshot STRING, real_raw_snapshot_sha256 STRING",
}


def schema(name: str) -> T.StructType:
    """The schema of a table; needs an active session."""
    return T.StructType.fromDDL(DDL[name])
