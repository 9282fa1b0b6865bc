"""Tables in and out: code files, feeds, findings, snapshots."""
