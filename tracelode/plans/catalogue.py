"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import evidence, graph, history, linking, packet, patterns, proposals, reconcile, state
from tracelode.plans import cases, oracle
from tracelode.sources.domain import Domain
from tracelode.streaming import detection

Query = Callable[[SparkSession, str], DataFrame]


def _upsert_latest(d: Domain) -> DataFrame:
    log = d.executions.select("user_id", "event_id", "event_type", "occurred")
    return graph.latest(log, ["user_id"], [F.col("occurred"), F.col("event_id")]).select("user_id", "event_id", "event_type")


def _replace_edges(d: Domain) -> DataFrame:
    """Open tickets' features are replaced by those of returned and late lines only."""
    new = d.lines.where("l_returnflag = 'R' and l_linenumber = 1 and status = 'open'").join(d.parts, F.col("l_partkey") == F.col("part")).select("project", "ticket_id", "feature").distinct()
    return graph.replaced(d.affects, new, ["project", "ticket_id"])


OPERATORS: dict[str, Callable[[Domain], DataFrame]] = {
    "debug_candidates": evidence.debug_candidates,
    "ticket_features": lambda d: d.affects,
    "ticket_errors": lambda d: d.ticket_errors,
    "feature_files": graph.feature_files,
    "feature_tests": graph.feature_tests,
    "module_fallback_tests": graph.module_fallback_tests,
    "error_known_issues": graph.error_known_issues,
    "known_issue_fixes": graph.known_issue_fixes,
    "file_recent_commits": graph.recent_commits,
    "traverse_degrees": graph.degrees,
    "evidence_primary": evidence.feature_evidence,
    "evidence_commits": evidence.commit_evidence,
    "evidence_dependency": history.dependency_evidence,
    "covered_tests": evidence.covered_tests,
    "score_decay": evidence.all_scored,
    "rank_known_issues": graph.rank_known_issues,
    "rank_fixes": graph.rank_fixes,
    "packet_json": evidence.packets,
    "quick_summary": evidence.quick_summary,
    "status_counts": graph.status_counts,
    "recall_module": graph.recall_module,
    "search_any": lambda d: graph.search(d, "small"),
    "diagnose": graph.diagnose,
    "upsert_latest": _upsert_latest,
    "replace_edges": _replace_edges,
    "exists_semi": lambda d: graph.existing(d.ticket_errors, d.issue_errors, ["project", "error"]),
    "dangling_edges_anti": lambda d: graph.dangling(d.ticket_errors, d.issue_errors, ["project", "error"]),
    "ambiguous_tokens": graph.ambiguous_tokens,
    "tokenize": linking.module_tokens,
    "text_tokens": linking.text_token_counts,
    "error_linker": linking.error_links,
    "slugify": linking.slugs,
    "requirements_parse": linking.packages,
    "role_classify": linking.roles,
    "mirrored_coverage": linking.mirrored_coverage,
    "closing_refs": linking.closing_turns,
    "confidence_band": linking.bands,
    "prior_snapshot_asof": history.prior_snapshots,
    "manifest_diff": history.manifest_changes,
    "manifest_change_counts": history.change_counts,
    "cursor_prefix": history.successful_prefix,
    "run_summary": history.run_summary,
    "test_path_resolution": history.test_path_resolution,
    "pattern_actionable": patterns.actionable,
    "pattern_new_bug": patterns.new_bug,
    "pattern_error_flagged": patterns.error_flagged,
    "pattern_ci_corroboration": patterns.ci_corroboration,
    "pattern_root_cause": patterns.root_cause,
    "pattern_file_escalation": patterns.file_escalation,
    "milestone_first": patterns.first_milestones,
    "escalation_sequence": patterns.escalation_sequence,
    "deleted_tickets": patterns.deleted_tickets,
    "backfill_created_at": patterns.backfill_created,
    "unflagged_tickets": patterns.unflagged,
    "proposal_verifier": state.verified_fields,
    "merge_candidates": proposals.merged_candidates,
    "module_groups": proposals.module_groups,
    "unclaimed_files": proposals.unclaimed_files,
    "duplicate_modules": proposals.duplicate_modules,
    "py_symbols": proposals.code_facts,
    "headings": proposals.part_headings,
    "sections": proposals.part_sections,
    "ticket_markdown": proposals.ticket_files,
    "git_log": proposals.git_records,
    "label_kind": proposals.label_kinds,
    "stream_actionable": detection.replay_actionable,
    "stream_new_bug": detection.replay_new_bug,
    "stream_error_flagged": detection.replay_error_flagged,
    "stream_ci_corroboration": detection.replay_ci_corroboration,
    "stream_root_cause": detection.replay_root_cause,
    "stream_file_escalation": detection.replay_file_escalation,
    "recall_feature": graph.recall_feature,
    "registry_list": graph.registry_list,
    "fix_commit": graph.fix_commits,
    "similarity_weighted_issues": graph.similar_issues,
    "evidence_test_failure": history.test_failure_evidence,
    "doc_penalty": evidence.document_penalty,
    "confidence_label": evidence.confidence_labels,
    "slug_collisions": linking.slug_collisions,
    "search_heading": lambda d: proposals.searched_headings(d, "Type"),
    "commit_edge_reconcile": reconcile.commit_edges,
    "expansion_backlog": reconcile.expansion_backlog,
    "flags_written_back": lambda d: reconcile.flags_written_back(d, 20.0),
    "pull_requests": reconcile.pull_requests,
    "point_read": lambda d: state.node(d.tickets, project="ASIA", ticket_id=7),
    "add_edge": lambda d: state.with_edges(d.affects, d.flags.join(d.files.select("project", "path", "feature"), ["project", "path"])),
    "traverse_fixes": state.fixes_by_traversal,
    "traverse_both": state.modules_near_features,
    "ad_hoc": lambda d: state.asked(d, "SELECT project, status, count(*) AS n FROM {ticket} WHERE status <> :status GROUP BY project, status", status="open"),
    "module_files": state.module_files,
    "commit_files": state.commit_files,
    "touching_commits": state.touching_commits,
    "feature_linker": state.linked_documents,
    "error_matcher": state.matched_orders,
    "new_investigations": state.new_investigations,
    "escalation_sweep": state.escalation_sweep,
    "debug_packet": packet.debug_packet,
    "packet_mentions": packet.mention_evidence,
    "packet_elements": packet.element_evidence,
    "packet_commits": packet.commit_evidence,
    "packet_file_evidence": packet.file_evidence,
    "slug_registry": state.part_registry,
    **{name: cases.query(name) for name in cases.CASES},
}


def queries() -> dict[str, Query]:
    def over(operator: Callable[[Domain], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(Domain(spark, sf_dir))

    return {name: over(f) for name, f in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.queries()
