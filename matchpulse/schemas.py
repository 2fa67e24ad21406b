"""Message and table schemas shared by the batch and streaming paths.

The field names below are fixed values: they are the wire contract of the messages.
"""

from pyspark.sql import types as T

PLAYER = "struct<team:string,state:struct<health:int,round_kills:int,round_totaldmg:int>,match_stats:struct<kills:int>>"
PLAYERS = f"map<string,{PLAYER}>"
EVENT = (
    "provider struct<steamid:string>, map struct<round:int,phase:string>, round struct<phase:string>, "
    f"phase_countdowns struct<phase:string,phase_ends_in:string>, allplayers {PLAYERS}"
)

PREDICTION = "sessionKey string, round int, probCtWin double, timestamp bigint"
RESPONSE = "correlationId string, probCtWin double, error string"

# Scoring inputs, in model order, with the request field that carries each one.
FEATURES = {
    "ct_alive": "ctAlive",
    "t_alive": "tAlive",
    "ct_total_hp": "ctTotalHp",
    "t_total_hp": "tTotalHp",
    "bomb_planted": "bombPlanted",
    "remaining_time": "remainingTime",
    "ct_alive_kills_prev3_sum": "ctAliveKillsPrev3",
    "ct_alive_damage_prev3_sum": "ctAliveDamagePrev3",
    "t_alive_kills_prev3_sum": "tAliveKillsPrev3",
    "t_alive_damage_prev3_sum": "tAliveDamagePrev3",
}
STATELESS = list(FEATURES)[:6]
PREV3 = list(FEATURES)[6:]

FEATURE_ROW = T.StructType(
    [
        T.StructField("session_key", T.StringType()),
        T.StructField("round_num", T.IntegerType()),
        T.StructField("event_timestamp", T.LongType()),
    ]
    + [
        T.StructField(name, T.FloatType() if name == "remaining_time" else T.IntegerType())
        for name in FEATURES
    ]
)

# Order of events inside a session: whole seconds first, then the position in the log.
ORDER = ["second", "partition", "offset"]
