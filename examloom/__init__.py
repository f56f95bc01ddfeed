"""Exam-record analytics as Spark jobs: tables in, tables out, nothing whole through the driver."""
