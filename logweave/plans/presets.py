"""Line formats of well-known public log sets."""

from __future__ import annotations

from logweave.plans.config import FormatConfig

# Line formats, time formats, masks, delimiters and tuned miner parameters.
_ALL = [
    FormatConfig(
        name="Android",
        log_format="{Date} {Time} {Pid:^} {Tid:>} {Level} {Component}: {Content}",
        timestamp_fields=("Date", "Time",),
        timestamp_format="%m-%d %H:%M:%S.%g",
        user_masks=((r"(/[\w-]+)+", "<#PATH#>"),),
        delimiters="=:",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.6},
            "Brain": {"var_thr": 5},
            "Drain": {"depth": 6, "sim_thr": 0.2},
            "JaccardDrain": {"depth": 6, "sim_thr": 0.2},
            "Spell": {"sim_thr": 0.95},
        },
    ),
    FormatConfig(
        name="Apache",
        log_format="[{DateTime}] [{Level}] {Content}",
        timestamp_fields=("DateTime",),
        timestamp_format="%a %b %d %H:%M:%S %Y",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.4},
            "Brain": {"var_thr": 4},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.6},
        },
    ),
    FormatConfig(
        name="BGL",
        log_format="{Label} {Timestamp} {Date} {Node} {DateTime} {NodeRepeat} {Type} {Component} {Level} {Content}",
        timestamp_fields=("Timestamp", "Date", "DateTime",),
        timestamp_format="epoch",
        user_masks=((r"core\.\d+", "<#CORE#>"), (r"\d+:[A-Fa-f\d]{8,}", "<#ADDR#>"),),
        delimiters="=()",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.5},
            "Brain": {"var_thr": 6},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.75},
        },
    ),
    FormatConfig(
        name="HDFS",
        log_format="{Date} {Time} {Pid} {Level} {Component}: {Content}",
        timestamp_fields=("Date", "Time",),
        timestamp_format="%y%m%d %H%M%S",
        user_masks=((r"blk_-?\d+", "<#BLK#>"),),
        delimiters=":",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.5},
            "Brain": {"var_thr": 2},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.7},
        },
    ),
    FormatConfig(
        name="HPC",
        log_format="{LogId} {Node} {Component} {State} {Timestamp} {Flag} {Content}",
        timestamp_fields=("Timestamp",),
        timestamp_format="epoch",
        delimiters="=:-",
        ex_args={
            "AEL": {"cluster_thr": 5, "merge_thr": 0.4},
            "Brain": {"var_thr": 5},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.65},
        },
    ),
    FormatConfig(
        name="Hadoop",
        log_format="{Date} {Time} {Level} [{Process}] {Component}: {Content}",
        timestamp_fields=("Date", "Time",),
        timestamp_format="%Y-%m-%d %H:%M:%S,%g",
        delimiters="=:_()",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.4},
            "Brain": {"var_thr": 6},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.7},
        },
    ),
    FormatConfig(
        name="HealthApp",
        log_format="{DateTime}|{Component}|{Pid}|{Content}",
        timestamp_fields=("DateTime",),
        timestamp_format="%Y%m%d-%-H:%-M:%-S:%g",
        user_masks=((r"\d+##\d+##\d+##\d+##\d+##\d+", "<#SEQ#>"),),
        delimiters="=:|",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.6},
            "Brain": {"var_thr": 4},
            "Drain": {"depth": 4, "sim_thr": 0.2},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.2},
            "Spell": {"sim_thr": 0.5},
        },
    ),
    FormatConfig(
        name="Linux",
        log_format="{Month} {Day} {Time} {Level} {Component}: {Content}",
        timestamp_fields=("Month", "Day", "Time",),
        timestamp_format="%b %d %H:%M:%S",
        delimiters="=:",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.6},
            "Brain": {"var_thr": 4},
            "Drain": {"depth": 6, "sim_thr": 0.39},
            "JaccardDrain": {"depth": 6, "sim_thr": 0.39},
            "Spell": {"sim_thr": 0.55},
        },
    ),
    FormatConfig(
        name="Mac",
        log_format="{Month}  {Day} {Time} {User} {Component}: {Content}",
        timestamp_fields=("Month", "Day", "Time",),
        timestamp_format="%b %d %H:%M:%S",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.6},
            "Brain": {"var_thr": 5},
            "Drain": {"depth": 6, "sim_thr": 0.7},
            "JaccardDrain": {"depth": 6, "sim_thr": 0.7},
            "Spell": {"sim_thr": 0.6},
        },
    ),
    FormatConfig(
        name="OpenSSH",
        log_format="{Month} {Day} {Time} {Component} sshd[{Pid}]: {Content}",
        timestamp_fields=("Month", "Day", "Time",),
        timestamp_format="%b %d %H:%M:%S",
        ex_args={
            "AEL": {"cluster_thr": 10, "merge_thr": 0.7},
            "Brain": {"var_thr": 6},
            "Drain": {"depth": 5, "sim_thr": 0.6},
            "JaccardDrain": {"depth": 5, "sim_thr": 0.6},
            "Spell": {"sim_thr": 0.8},
        },
    ),
    FormatConfig(
        name="OpenStack",
        log_format="{Logrecord} {Date} {Time} {Pid} {Level} {Component} [{ADDR}] {Content}",
        timestamp_fields=("Date", "Time",),
        timestamp_format="%Y-%m-%d %H:%M:%S.%g",
        user_masks=((r"\[instance:(.*?)\]", "<#INST#>"), (r"(/[\w-]+)+", "<#PATH#>"),),
        ex_args={
            "AEL": {"cluster_thr": 6, "merge_thr": 0.5},
            "Brain": {"var_thr": 5},
            "Drain": {"depth": 5, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 5, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.9},
        },
    ),
    FormatConfig(
        name="Proxifier",
        log_format="[{DateTime}] {Program} - {Content}",
        timestamp_fields=("DateTime",),
        timestamp_format="%m.%d %H:%M:%S",
        user_masks=((r"<\d+\ssec", "<#DURATION#>"),),
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.4},
            "Brain": {"var_thr": 3},
            "Drain": {"depth": 3, "sim_thr": 0.6},
            "JaccardDrain": {"depth": 3, "sim_thr": 0.6},
            "Spell": {"sim_thr": 0.85},
        },
    ),
    FormatConfig(
        name="Spark",
        log_format="{Date} {Time} {Level} {Component}: {Content}",
        timestamp_fields=("Date", "Time",),
        timestamp_format="%y/%m/%d %H:%M:%S",
        delimiters=":",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.4},
            "Brain": {"var_thr": 4},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.55},
        },
    ),
    FormatConfig(
        name="Thunderbird",
        log_format="{Label} {Timestamp} {Date} {User} {Month} {Day} {Time} {Location} {Component}: {Content}",
        timestamp_fields=("Timestamp", "Date", "Month", "Day", "Time",),
        timestamp_format="epoch",
        delimiters="=:",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.4},
            "Brain": {"var_thr": 3},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.5},
        },
    ),
    FormatConfig(
        name="Windows",
        log_format="{Date} {Time}, {Level:<} {Component}    {Content}",
        timestamp_fields=("Date", "Time",),
        timestamp_format="%c",
        delimiters="=:[]",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.4},
            "Brain": {"var_thr": 3},
            "Drain": {"depth": 5, "sim_thr": 0.7},
            "JaccardDrain": {"depth": 5, "sim_thr": 0.7},
            "Spell": {"sim_thr": 0.7},
        },
    ),
    FormatConfig(
        name="Zookeeper",
        log_format="{Date} {Time} - {Level:<} [{Node}:{Component}@{Id}] - {Content}",
        timestamp_fields=("Date", "Time",),
        timestamp_format="%Y-%m-%d %H:%M:%S,%g",
        delimiters="=:",
        ex_args={
            "AEL": {"cluster_thr": 2, "merge_thr": 0.4},
            "Brain": {"var_thr": 3},
            "Drain": {"depth": 4, "sim_thr": 0.5},
            "JaccardDrain": {"depth": 4, "sim_thr": 0.5},
            "Spell": {"sim_thr": 0.7},
        },
    ),
]

PRESETS = {preset.name: preset for preset in _ALL}
