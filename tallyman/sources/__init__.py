"""Readers and writers: model views, change feeds, queues, relational tables, the event lake and snapshots."""
