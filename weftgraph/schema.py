"""Schemas of items, nodes, edges and the rest of a graph.

Every node and edge has an `ord`: (epoch, item, position, sub). It is the order in which a
sequential reader would have met them; first and last wins are decided by it and by nothing else."""

from __future__ import annotations

ORD = "struct<epoch:int,item:bigint,pos:bigint,sub:int>"
STORAGE_REF = "struct<provider:string,namespace:string,physical_id:string,logical_path:string,revision:string,permission_key:string>"

ITEM = f"id string, text string, title string, path string, url string, mime_type string, source_type string, parent_id string, storage_ref {STORAGE_REF}, metadata string, updated_at string, hash string, item_seq bigint"

#: What an extractor returns for a node and an edge, without `ord`.
RAW_NODE = f"id:string,label:string,type:string,source_item_id:string,source_url:string,source_location:string,path:string,href:string,hash:string,updated_at:string,metadata:string,storage_ref:{STORAGE_REF}"
RAW_EDGE = "source:string,target:string,relation:string,confidence:string,confidence_score:double,source_item_id:string,source_location:string,context:string,metadata:string"
EXTRACTION = f"item_seq bigint, item_id string, nodes array<struct<{RAW_NODE}>>, edges array<struct<{RAW_EDGE}>>, error string"

HYPEREDGE = "ord bigint, id string, label string, nodes array<string>, metadata string"
TIMELINE = "id string, timestamp string, event string, source_item_id string, label string, hash string, previous_hash string, node_ids array<string>, metadata string"
SNAPSHOT = "id string, timestamp string, label string, node_count bigint, edge_count bigint, source_count bigint, community_count bigint, source_hashes map<string,string>"

NODE_COLUMNS = ["ord", "id", "label", "type", "source_item_id", "source_url", "source_location", "path", "href", "hash", "updated_at", "metadata", "storage_ref", "normalized_label", "merged_from", "community"]
EDGE_COLUMNS = ["ord", "source", "target", "relation", "confidence", "confidence_score", "source_item_id", "source_location", "context", "metadata"]

CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
ARTIFACTS = tuple("json report html wiki manifest timeline cypher dot graphml".split())
#: Node types that count as labels of others rather than as things of their own.
SIDE_TYPES = ("tag", "resource")
