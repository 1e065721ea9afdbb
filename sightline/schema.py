"""Schemas of the engine's entities."""

from __future__ import annotations

#: Kinds, those that recur, states, results and sources of log entries.
KINDS = ("inspection", "secondary_injection_test", "trip_test", "firmware_update", "settings_change", "fault", "repair", "other")
PERIODIC = ("inspection", "secondary_injection_test", "trip_test")
STATUSES = ("open", "in_progress", "done")
RESULTS = ("ok", "remarks", "fault")
SOURCES = ("autotag", "field-app", "seed")
#: Shortest and longest text of an entry's fields. Those in TRIMMED are measured without outer blanks.
LENGTHS = {"title": (3, 120), "performedBy": (2, 80), "company": (0, 80), "findings": (0, 2000), "actions": (0, 2000), "firmwareBefore": (0, 40), "firmwareAfter": (0, 40), "workPermitRef": (0, 60)}
TRIMMED = ("title", "performedBy", "company", "firmwareBefore", "firmwareAfter", "workPermitRef")
ATTACHMENTS = 10

DETECTION = """id string, scanPointId string, image string, assetTypeId string, ocrText string, confidence double,
 bbox array<int>, pitch double, yaw double, status string, instanceId string"""
SCAN_POINT = "scanPointId string, position array<double>"
DEVICE = """id string, assetTypeId string, variant string, functionalLocation string, serialNo string, site string,
 position array<double>, anchors array<struct<scanPointId:string,yaw:double,pitch:double>>, tolDeg double, commissionedAt date,
 maintenanceIntervalMonths int, demoProfile string, isDemo boolean"""
ENTRY = """id string, instanceId string, kind string, status string, title string, performedAt date, performedBy string,
 company string, findings string, actions string, result string, nextDueAt date, firmwareBefore string, firmwareAfter string,
 workPermitRef string, attachments array<struct<name:string,url:string>>, source string, version int, createdAt timestamp, updatedAt timestamp"""
FLOOR_DEVICE = """id string, x double, y double, z double, assetTypeId string, status string, detectionIds array<string>,
 scanPointIds array<string>, bestDetectionId string, method string, positionSpread double, confidenceMax double"""
POINT = "scan string, ord bigint, x float, y float, z float, r smallint, g smallint, b smallint"
CANDIDATE = """scan string, view string, ord int, x1 double, y1 double, x2 double, y2 double, conf double, yaw double, pitch double,
 size double, similarity double"""
POSE = """imageWidth int, imageHeight int, focalLength double, pixelWidth double, pixelHeight double, principalPointX double,
 principalPointY double, rotation array<double>, translation array<double>"""
