"""Pipeline compiler, end-to-end flows, fixtures and the registered queries."""
