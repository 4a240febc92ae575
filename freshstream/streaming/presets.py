"""Latency / throughput presets: trigger interval and admission control.

A preset bounds a micro-batch by rows and by bytes and sets the trigger.  The
limits are the reference's flush settings: a block of rows for low latency,
rows, bytes and seconds of a load job for the balanced one.  A Kafka source
takes the row limit as it is.  A file source counts files: where the log's files
hold a known number of rows at most (``rows_per_file``, see
``event_log.append_chunk``), the row limit becomes ``maxFilesPerTrigger``;
otherwise the byte limit applies (Spark takes one of the two).

  low_latency  1 s,  65,536 rows
  balanced     5 s,  300,000 rows, 200 MB
  throughput   30 s, 5,000,000 rows, 1 GB
  catch_up     what exists now, in batches of at most 1 GB, then stop
  replay       what exists now, in one batch, then stop
  asap         the next batch as soon as the one before ends
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preset:
    trigger: dict = field(default_factory=dict)
    rows: int | None = None
    bytes: int | None = None

    def file_options(self, rows_per_file: int | None = None) -> dict[str, int]:
        """Options of a file source."""
        if self.rows is not None and rows_per_file:
            return {"maxFilesPerTrigger": max(1, self.rows // rows_per_file)}
        return {} if self.bytes is None else {"maxBytesPerTrigger": self.bytes}

    def kafka_options(self) -> dict[str, str]:
        """Options of a Kafka source: at most ``rows`` offsets a batch; a batch
        below them waits no longer than the trigger interval."""
        if self.rows is None:
            return {}
        out = {"maxOffsetsPerTrigger": str(self.rows)}
        if "processingTime" in self.trigger:
            out |= {"minOffsetsPerTrigger": str(max(1, self.rows // 10)),
                    "maxTriggerDelay": self.trigger["processingTime"]}
        return out


PRESETS = {
    "low_latency": Preset({"processingTime": "1 second"}, 65_536, 50 << 20),
    "balanced": Preset({"processingTime": "5 seconds"}, 300_000, 200 << 20),
    "throughput": Preset({"processingTime": "30 seconds"}, 5_000_000, 1 << 30),
    "catch_up": Preset({"availableNow": True}, None, 1 << 30),
    "replay": Preset({"availableNow": True}),
    "asap": Preset({"processingTime": "0 seconds"}),
}
