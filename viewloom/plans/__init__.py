"""Bindings of fields to views, and the dashboard that derives all views from one frame."""
