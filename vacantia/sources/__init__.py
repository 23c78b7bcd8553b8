"""Readers that turn landed payloads and filings into typed tables."""
