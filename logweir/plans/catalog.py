"""The catalog: tables of a cluster's state, their columns and types, and which predicates they ask for."""

from __future__ import annotations

# The tables and their columns.
DECLARED = """
append_outliers: node_id INTEGER, observed_node_id INTEGER, appends_success BIGINT, appends_failed BIGINT, msec_since BIGINT, is_outlier BOOL
append_throughput: node_id INTEGER, log_group_name TEXT, throughput_1min BIGINT, throughput_5min BIGINT, throughput_10min BIGINT
catchup_queues: node_id INTEGER, client TEXT, queued_total BIGINT, queued_immediate BIGINT, queued_delayed BIGINT, record_bytes_queued BIGINT, storage_task_in_flight INTEGER, ping_timer_active INTEGER
chunk_rebuildings: node_id INTEGER, log_id LOGID, shard INTEGER, min_lsn LSN, max_lsn LSN, chunk_id BIGINT, block_id BIGINT, total_bytes BIGINT, oldest_timestamp TIME, stores_in_flight BIGINT, amends_in_flight BIGINT, amend_self_in_flight BIGINT, started TIME
client_read_streams: node_id INTEGER, log_id LOGID, id BIGINT, next_lsn_to_deliver BIGINT, window_high LSN, until_lsn LSN, read_set_size BIGINT, gap_end_outside_window LSN, trim_point LSN, gap_nodes_next_lsn TEXT, unavailable_nodes TEXT, connection_health TEXT, redelivery_inprog BOOL, filter_version BIGINT
cluster_state: node_id INTEGER, status TEXT, dead_nodes TEXT, boycotted_nodes TEXT, unhealthy_nodes TEXT, overloaded_nodes TEXT
epoch_store: log_id LOGID, status TEXT, since BIGINT, epoch BIGINT, replication TEXT, storage_set_size BIGINT, storage_set TEXT, flags TEXT, nodeset_signature BIGINT, target_nodeset_size BIGINT, nodeset_seed BIGINT, lce BIGINT, meta_lce BIGINT, written_by TEXT, tail_record TEXT
event_log: node_id INTEGER, delta_log_id LOGID, snapshot_log_id LOGID, version LSN, delta_read_ptr LSN, delta_replay_tail LSN, snapshot_read_ptr LSN, snapshot_replay_tail LSN, stalled_waiting_for_snapshot LSN, delta_appends_in_flight BIGINT, deltas_pending_confirmation BIGINT, snapshot_in_flight BIGINT, delta_log_bytes BIGINT, delta_log_records BIGINT, delta_log_healthy BOOL, propagated_read_ptr LSN
graylist: node_id INTEGER, worker_id INTEGER, graylisted_node_index INTEGER
historical_metadata: log_id LOGID, status TEXT, since BIGINT, epoch BIGINT, replication TEXT, storage_set_size BIGINT, storage_set TEXT, flags TEXT
historical_metadata_legacy: log_id LOGID, status TEXT, since BIGINT, epoch BIGINT, replication TEXT, storage_set_size BIGINT, storage_set TEXT, flags TEXT, lsn LSN, timestamp BIGINT
info: node_id INTEGER, pid BIGINT, version TEXT, package TEXT, build_user TEXT, build_time TEXT, start_time TEXT, server_id TEXT, shards_missing_data TEXT, min_proto BIGINT, max_proto BIGINT, is_auth_enabled BOOL, auth_type TEXT, is_unauthenticated_allowed BOOL, is_permission_checking_enabled BOOL, permission_checker_type TEXT, rocksdb_version TEXT
info_config: node_id INTEGER, uri TEXT, source INTEGER, hash TEXT, last_modified TIME, last_loaded TIME
info_rsm: node_id INTEGER, peer_id INTEGER, state TEXT, logsconfig_in_memory_version LSN, logsconfig_durable_version LSN, eventlog_in_memory_version LSN, eventlog_durable_version LSN
iterators: node_id INTEGER, column_family TEXT, log_id LOGID, is_tailing BIGINT, is_blocking BIGINT, type TEXT, rebuilding BIGINT, high_level_id BIGINT, created_timestamp TIME, more_context TEXT, last_seek_lsn LSN, last_seek_timestamp TIME, version BIGINT
log_groups: name TEXT, logid_lo LOGID, logid_hi LOGID, replication_property TEXT, synced_copies INTEGER, max_writes_in_flight INTEGER, backlog_duration_sec INTEGER, storage_set_size INTEGER, delivery_latency INTEGER, scd_enabled INTEGER, custom_fields TEXT
log_rebuildings: node_id INTEGER, log_id LOGID, shard INTEGER, until_lsn LSN, rebuilt_up_to LSN, num_replicated BIGINT, bytes_replicated BIGINT
log_storage_state: node_id INTEGER, log_id LOGID, shard INTEGER, last_released LSN, last_released_src TEXT, trim_point LSN, per_epoch_metadata_trim_point LSN, seal BIGINT, sealed_by TEXT, soft_seal BIGINT, soft_sealed_by TEXT, last_recovery_time BIGINT, log_removal_time BIGINT, lce BIGINT, latest_epoch BIGINT, latest_epoch_offset TEXT, permanent_errors BIGINT
logsconfig_rsm: node_id INTEGER, delta_log_id LOGID, snapshot_log_id LOGID, version LSN, delta_read_ptr LSN, delta_replay_tail LSN, snapshot_read_ptr LSN, snapshot_replay_tail LSN, stalled_waiting_for_snapshot LSN, delta_appends_in_flight BIGINT, deltas_pending_confirmation BIGINT, snapshot_in_flight BIGINT, delta_log_bytes BIGINT, delta_log_records BIGINT, propagated_read_ptr BIGINT
logsdb_directory: node_id INTEGER, shard INTEGER, log_id BIGINT, partition BIGINT, first_lsn LSN, max_lsn LSN, flags TEXT, approximate_size_bytes BIGINT
logsdb_metadata: node_id INTEGER, shard BIGINT, column_family TEXT, approx_size BIGINT, l0_files BIGINT, immutable_memtables BIGINT, memtable_flush_pending BIGINT, active_memtable_size BIGINT, all_memtables_size BIGINT, est_num_keys BIGINT, est_mem_by_readers BIGINT, live_versions BIGINT
nodes: node_id INTEGER, name TEXT, address TEXT, ssl_address TEXT, admin_address TEXT, generation BIGINT, location TEXT, sequencer INTEGER, storage INTEGER, sequencer_weight REAL, storage_state TEXT, storage_weight REAL, num_shards BIGINT, is_metadata_node INTEGER
partitions: node_id INTEGER, shard BIGINT, id BIGINT, start_time TIME, min_time TIME, max_time TIME, min_durable_time TIME, max_durable_time TIME, last_compacted TIME, approx_size BIGINT, l0_files BIGINT, immutable_memtables BIGINT, memtable_flush_pending BIGINT, active_memtable_size BIGINT, all_not_flushed_memtables_size BIGINT, all_memtables_size BIGINT, est_num_keys BIGINT, est_mem_by_readers BIGINT, live_versions BIGINT, current_version BIGINT, append_dirtied_by TEXT, rebuild_dirtied_by TEXT, copyset_index_enabled BOOL
purges: node_id INTEGER, log_id LOGID, state TEXT, current_last_clean_epoch BIGINT, purge_to BIGINT, new_last_clean_epoch BIGINT, sequencer TEXT, epoch_state TEXT
readers: node_id INTEGER, shard INTEGER, client TEXT, log_id LOGID, start_lsn LSN, until_lsn LSN, read_pointer LSN, last_delivered LSN, last_record LSN, window_high LSN, last_released LSN, catching_up INTEGER, window_end INTEGER, known_down TEXT, filter_version BIGINT, last_batch_status TEXT, created TIME, last_enqueue_time TIME, last_batch_started_time TIME, storage_task_in_flight INTEGER, csid TEXT, rsid TEXT, tcp_sndbuf INTEGER
record: node_id INTEGER, log_id LOGID, lsn LSN, shard INTEGER, wave INTEGER, recovery_epoch INTEGER, timestamp TEXT, last_known_good INTEGER, copyset TEXT, flags TEXT, offset_within_epoch TEXT, optional_keys TEXT, is_written_by_recovery BOOL, payload TEXT
record_cache: node_id INTEGER, log_id LOGID, shard INTEGER, epoch BIGINT, payload_bytes BIGINT, num_records BIGINT, consistent BOOL, disabled BOOL, head_esn BIGINT, max_esn BIGINT, first_lng BIGINT, offset_within_epoch TEXT, tail_record_lsn BIGINT, tail_record_ts BIGINT
record_csi: node_id INTEGER, log_id LOGID, lsn LSN, shard INTEGER, wave INTEGER, recovery_epoch INTEGER, timestamp TEXT, last_known_good INTEGER, copyset TEXT, flags TEXT, offset_within_epoch TEXT, optional_keys TEXT, is_written_by_recovery BOOL, payload TEXT
recoveries: node_id INTEGER, log_id LOGID, epoch BIGINT, state TEXT, lng BIGINT, dig_sz BIGINT, dig_fmajority BIGINT, dig_replic BIGINT, dig_author BIGINT, holes_plugged BIGINT, holes_replicate BIGINT, holes_conflict BIGINT, records_replicate BIGINT, n_mutators BIGINT, recovery_state TEXT, created TIME, restarted TIME, n_restarts BIGINT
sequencers: node_id INTEGER, log_id LOGID, metadata_log_id TEXT, state TEXT, epoch BIGINT, next_lsn LSN, meta_last_released LSN, last_released LSN, last_known_good LSN, in_flight BIGINT, last_used_ms BIGINT, state_duration_ms BIGINT, nodeset_state TEXT, preempted_epoch BIGINT, preempted_by BIGINT, draining BIGINT, metadata_log_written BIGINT, trim_point LSN, last_byte_offset TEXT, bytes_per_second REAL, throughput_window_seconds REAL, seconds_until_nodeset_adjustment REAL
settings: node_id INTEGER, bundle_name TEXT, name TEXT, current_value TEXT, default_value TEXT, from_cli TEXT, from_config TEXT, from_admin_cmd TEXT
shard_authoritative_status: node_id INTEGER, shard BIGINT, rebuilding_version TEXT, authoritative_status TEXT, donors_remaining TEXT, drain INTEGER, mode TEXT, dirty_ranges TEXT, rebuilding_is_authoritative INTEGER, data_is_recoverable INTEGER, source TEXT, rebuilding_started_ts TEXT, rebuilding_completed_ts TEXT
shard_authoritative_status_spew: node_id INTEGER, shard BIGINT, rebuilding_version TEXT, authoritative_status TEXT, donors_remaining TEXT, drain INTEGER, mode TEXT, dirty_ranges TEXT, rebuilding_is_authoritative INTEGER, data_is_recoverable INTEGER, source TEXT, rebuilding_started_ts TEXT, rebuilding_completed_ts TEXT, acked INTEGER, ack_lsn TEXT, ack_version TEXT, donors_complete TEXT, donors_complete_authoritatively TEXT
shard_authoritative_status_verbose: node_id INTEGER, shard BIGINT, rebuilding_version TEXT, authoritative_status TEXT, donors_remaining TEXT, drain INTEGER, mode TEXT, dirty_ranges TEXT, rebuilding_is_authoritative INTEGER, data_is_recoverable INTEGER, source TEXT, rebuilding_started_ts TEXT, rebuilding_completed_ts TEXT, acked INTEGER, ack_lsn TEXT, ack_version TEXT
shard_rebuildings: node_id INTEGER, shard_id BIGINT, rebuilding_set TEXT, version LSN, global_window_end TIME, progress_timestamp TIME, num_logs_waiting_for_plan BIGINT, total_memory_used BIGINT, num_active_logs BIGINT, participating INTEGER, time_by_state TEXT, task_in_flight INTEGER, persistent_error INTEGER, read_buffer_bytes BIGINT, records_in_flight BIGINT, read_pointer TEXT, progress REAL
shards: node_id INTEGER, shard BIGINT, is_failing BIGINT, accepting_writes TEXT, rebuilding_state TEXT, default_cf_version BIGINT, dirty_state TEXT
sockets: node_id INTEGER, state TEXT, name TEXT, pending_kb REAL, available_kb REAL, read_mb REAL, write_mb REAL, read_cnt INTEGER, write_cnt INTEGER, bytes_per_second REAL, rwnd_limited_pct REAL, sndbuf_limited_pct REAL, proto INTEGER, sendbuf INTEGER, is_ssl INTEGER, fd INTEGER
stats: node_id INTEGER, name TEXT, value BIGINT
stats_rocksdb: node_id INTEGER, name TEXT, value BIGINT
storage_tasks: node_id INTEGER, shard BIGINT, priority TEXT, is_write_queue BOOL, sequence_no BIGINT, thread_type TEXT, task_type TEXT, enqueue_time TIME, durability TEXT, log_id LOGID, lsn LSN, client_id TEXT, client_address TEXT, extra_info TEXT
stored_logs: node_id INTEGER, log_id LOGID, shard BIGINT, highest_lsn LSN, highest_partition BIGINT, highest_timestamp_approx TIME
sync_sequencer_requests: node_id INTEGER, log_id LOGID, until_lsn LSN, last_released_lsn LSN, last_status TEXT
"""

#: Tables that can't be read without these columns being constrained.
REQUIRED = {"record": ("log_id", "lsn"), "record_csi": ("log_id", "lsn")}


def parse_declarations(text: str) -> dict[str, dict[str, str]]:
    """{table: {column: type}} of lines ``table: column TYPE, column TYPE, ...``."""
    out = {}
    for line in text.strip().splitlines():
        name, _, columns = line.partition(":")
        out[name.strip()] = dict(c.split() for c in columns.split(",") if c.strip())
    return out


def declared() -> dict[str, dict[str, str]]:
    return parse_declarations(DECLARED)
