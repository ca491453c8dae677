"""Fixed texts of the built-in rules: one row per rule."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RuleInfo:
    rule_id: str
    title: str
    category: str
    severity: str
    why: str
    fix: str
    needs: str = ""  # "", "source", "dynamic" or "dependencies"
    origin: str = "builtin"


def _r(rule_id, title, category, severity, why, fix, needs=""):
    return RuleInfo(rule_id, title, category, severity, why, fix, needs)


RULES: tuple[RuleInfo, ...] = (
    _r("INJ-001", "Wording that gives the agent other orders", "prompt-injection", "high",
       "A model can't tell whose order counts; one in metadata speaks as loudly as the user.", "Delete the wording or leave the server out."),
    _r("INJ-002", "Characters nobody can see", "prompt-injection", "high",
       "People review what is printed, models read every character.", "Strip all unprinted characters."),
    _r("INJ-003", "Readable text inside base64", "prompt-injection", "medium",
       "What is encoded escapes review and plain filters.", "Say it in clear text, or not at all."),
    _r("INJ-004", "Orders inside returned content", "prompt-injection", "high",
       "Whatever a call returns is read by the agent as well.", "Give back data, never orders.", "dynamic"),
    _r("INJ-005", "Control codes for a terminal", "prompt-injection", "medium",
       "Control codes can redraw or hide what a console prints.", "Filter control codes out."),
    _r("POISON-001", "A tag addressed to the model", "tool-poisoning", "high",
       "Such a tag sets its text apart from the description people read.", "Write plain sentences."),
    _r("POISON-002", "The user shall not know", "tool-poisoning", "high",
       "There is no honest reason to keep a user uninformed.", "Do not use the server until this is explained."),
    _r("POISON-003", "Wants credential files read", "tool-poisoning", "high",
       "Another tool may read the file and this one gets its text.", "Configure credentials on the server itself."),
    _r("POISON-004", "Wants the conversation or secrets", "tool-poisoning", "critical",
       "What is handed over can't be taken back.", "Delete the demand."),
    _r("POISON-005", "A parameter made for private context", "tool-poisoning", "medium",
       "Agents tend to fill each field they see.", "Delete fields the task doesn't need."),
    _r("POISON-006", "Pushes itself into the order of calls", "tool-poisoning", "medium",
       "A description is in effect even if its tool is never used.", "Say what the tool does and nothing about others."),
    _r("POISON-007", "Text names a way out for data", "data-exfiltration", "high",
       "Public catchers of requests hide who receives the data.", "Ask what is sent there and why."),
    _r("SHADOW-001", "Orders about somebody else's tool", "tool-shadowing", "high",
       "It changes how a trusted tool is used without being called.", "Keep each description to its own tool."),
    _r("SHADOW-002", "Everything goes to one fixed recipient", "tool-shadowing", "critical",
       "A third party reads along from then on.", "Leave the server out and look at what was sent already."),
    _r("SHADOW-003", "Two servers, one tool name", "tool-shadowing", "medium",
       "The agent may pick the wrong one of them.", "Give one of them another name."),
    _r("SHADOW-004", "A name with foreign look-alikes", "tool-shadowing", "high",
       "On screen it can't be told from the tool it copies.", "Allow names in plain Latin letters only."),
    _r("EXEC-001", "Runs whatever it is given", "command-execution", "high",
       "Control over the agent becomes control over the host.", "Confine it and ask before each call."),
    _r("EXEC-002", "Input ends up in a command", "command-execution", "critical",
       "A shell reads more than one command into a text.", "Start programs with a list of arguments, without a shell.", "source"),
    _r("EXEC-003", "Input ends up as code", "code-execution", "critical",
       "Such input has all the rights of the server.", "Parse the input instead of evaluating it.", "source"),
    _r("EXEC-004", "Loads data that can carry code", "code-execution", "high",
       "The format runs what it contains while it is read.", "Choose a format that holds data only.", "source"),
    _r("FS-001", "Changes or removes files", "filesystem", "medium",
       "A misled agent destroys or plants files with it.", "Confine it to a folder and ask before each call."),
    _r("FS-002", "Reads files wherever asked", "filesystem", "low",
       "With any way out at hand, secrets leave.", "Confine it to the folders of its task."),
    _r("FS-003", "Input picks a path without a check", "filesystem", "high",
       "A path with dots climbs out of its folder.", "Normalise the path, then compare it with the folder.", "source"),
    _r("FS-004", "Code names credential files", "filesystem", "high",
       "Few programs have a reason to open them.", "Have the author explain the access.", "source"),
    _r("NET-001", "Fetches any address", "network", "medium",
       "Inner services come within reach, and data gets out.", "List the hosts it may talk to."),
    _r("NET-002", "Code talks to a catcher of requests", "data-exfiltration", "high",
       "A product of its own would have a host of its own.", "Look at what the code sends there.", "source"),
    _r("NET-003", "Input picks the address of a request", "network", "medium",
       "Inner services and metadata endpoints come within reach.", "Compare the host with a list first.", "source"),
    _r("SQL-001", "Takes whole SQL statements", "injection", "medium",
       "One misled call reads or empties a table.", "Offer fixed queries, or an account that can only read."),
    _r("SQL-002", "Input becomes part of SQL", "injection", "high",
       "A quote in the input ends the text and starts a statement.", "Bind values as parameters.", "source"),
    _r("SECRET-001", "A secret in view of the agent", "secrets", "high",
       "From there it travels into logs and into other tools.", "Take it out and issue a new one."),
    _r("SECRET-002", "A secret written into a configuration", "secrets", "medium",
       "Such files are copied, shared and backed up.", "Refer to a variable and issue a new key."),
    _r("SECRET-003", "A secret written into code", "secrets", "high",
       "Each reader of the code holds it.", "Read it from the environment and issue a new one.", "source"),
    _r("SECRET-004", "Wants a secret as an argument", "secrets", "low",
       "Arguments are kept with the conversation.", "Let the server look up its own secrets."),
    _r("SECRET-005", "Code takes the environment as a whole", "secrets", "high",
       "Keys of other programs lie there too.", "Ask for single variables.", "source"),
    _r("SECRET-006", "Gives out environment variables", "secrets", "high",
       "Keys of the server reach the conversation.", "Answer with chosen settings only."),
    _r("PRIV-001", "Text speaks of higher rights", "privilege", "medium",
       "Few tools have a reason for them.", "Start it under an ordinary account."),
    _r("PRIV-002", "Launched with more rights than needed", "privilege", "high",
       "What goes wrong in it goes wrong for the whole host.", "Launch it without these options."),
    _r("PERM-001", "Reads private things and can send", "excessive-permissions", "medium",
       "A single order is enough to carry a secret away.", "Put reading and sending into different servers."),
    _r("PERM-002", "Many kinds of power in one server", "excessive-permissions", "low",
       "Each kind adds to what one mistake costs.", "Disable what the task doesn't use."),
    _r("PERM-003", "Writes to anybody", "excessive-permissions", "low",
       "Messages leave under the user's name.", "Allow known recipients only."),
    _r("SCOPE-001", "Code goes beyond its description", "excessive-permissions", "high",
       "Consent was given to the description.", "Describe it, or don't use it.", "source"),
    _r("SCOPE-002", "Hints that don't fit the tool", "excessive-permissions", "medium",
       "On the strength of a hint clients don't ask.", "Set hints that are true."),
    _r("CFG-001", "Starts whichever version is newest", "supply-chain", "low",
       "Tomorrow's start may run other code than today's.", "Name one version."),
    _r("CFG-002", "A shell stands before the server", "configuration", "low",
       "More than the server may be started by it.", "Name the program itself."),
    _r("CFG-003", "Installed straight from an address", "supply-chain", "medium",
       "What lies there may be exchanged unnoticed.", "Install a release and pin it."),
    _r("CFG-004", "An image that may move", "supply-chain", "low",
       "A tag can point to other content tomorrow.", "Give the digest of the image."),
    _r("CFG-005", "Variables that alter other programs", "configuration", "high",
       "They slip code in or turn protection off.", "Unset the variable."),
    _r("AUTH-001", "No encryption on the way to the server", "authentication", "high",
       "Whoever sits on the line reads and alters it.", "Serve it over TLS."),
    _r("AUTH-002", "Power without a login", "authentication", "high",
       "Knowing the address is enough to use it.", "Put a login in front."),
    _r("AUTH-003", "Credentials inside an address", "authentication", "medium",
       "Addresses are logged all along the way.", "Move credentials into a header."),
    _r("SRC-001", "Unpacks code and runs it", "code-execution", "critical",
       "Code that means well can be read.", "Keep away from it.", "source"),
    _r("SRC-002", "Hands a shell to a remote host", "command-execution", "critical",
       "The far end then owns the machine.", "Keep away from it.", "source"),
    _r("SRC-003", "Reaches for places that run at start", "privilege", "high",
       "What is put there comes back after a restart.", "Have the author explain the access.", "source"),
    _r("SRC-004", "Input is compiled as a template", "code-execution", "high",
       "Template languages can call code.", "Keep the template fixed and pass input as values.", "source"),
    _r("DEP-001", "A package on a list of harmful ones", "supply-chain", "critical",
       "An advisory names this very release.", "Uninstall it and replace every key it could see.", "dependencies"),
    _r("DEP-002", "A package one slip away from a known one", "supply-chain", "high",
       "Such names are registered for mistyped installs.", "Compare name and publisher.", "dependencies"),
    _r("DEP-003", "Code runs during installation", "supply-chain", "medium",
       "It acts before anything of the package is used.", "Read the step, or install with steps turned off.", "dependencies"),
    _r("DEP-004", "A dependency without a fixed release", "supply-chain", "low",
       "Other content may arrive with the next install.", "Depend on released versions.", "dependencies"),
    _r("DYN-001", "A planted value returned", "data-exfiltration", "critical",
       "It was readable only by snooping.", "Assume the worst about this server.", "dynamic"),
    _r("DYN-002", "Definitions moved during a session", "tool-poisoning", "high",
       "What was approved is no longer what runs.", "Compare before and after.", "dynamic"),
    _r("DYN-003", "Definitions moved since they were recorded", "tool-poisoning", "medium",
       "Approval belonged to the older text.", "Read the new text, then record it."),
    _r("DYN-004", "Started a shell or a network program", "runtime-behavior", "high",
       "Nothing it was asked to do calls for one.", "Trace what starts it.", "dynamic"),
    _r("DYN-005", "Talked to outside hosts", "runtime-behavior", "medium",
       "It may be statistics, or your data.", "Ask what the hosts are for.", "dynamic"),
    _r("DYN-006", "Wrote where credentials or start files lie", "runtime-behavior", "high",
       "Programs that want to stay write there.", "Assume the worst about this server.", "dynamic"),
    _r("DYN-007", "Ran into a limit on resources", "runtime-behavior", "medium",
       "It may be a mistake, or mining.", "Watch what it does when it starts.", "dynamic"),
    _r("PROTO-001", "Asked for powers it wasn't offered", "protocol", "medium",
       "It could use the client's model or question the user.", "Refuse such requests.", "dynamic"),
    _r("PROTO-002", "Output between messages", "protocol", "low",
       "Clients stumble over it.", "Write logs to another stream.", "dynamic"),
    _r("PROTO-003", "Refers the client to a foreign host", "protocol", "high",
       "Tokens would be sent to that host.", "Don't connect.", "dynamic"),
    _r("PROTO-004", "More output than sensible", "protocol", "low",
       "It crowds out everything else the agent reads.", "Ask why answers are this large.", "dynamic"),
    _r("PROTO-005", "An outdated protocol", "protocol", "info",
       "Later versions brought protection this one lacks.", "Move to a newer release."),
    _r("QUALITY-001", "Nothing said about a tool", "quality", "info",
       "Neither people nor models can judge it.", "Add a sentence on what it does."),
    _r("QUALITY-002", "A schema that lets anything in", "quality", "info",
       "Mistakes reach the code unchecked.", "State a type for each parameter."),
    _r("QUALITY-003", "A description of unusual length", "quality", "low",
       "In much text a few words go unread.", "Shorten it."),
    _r("QUALITY-004", "Several tools under one name", "tool-shadowing", "medium",
       "Clients differ in which one they take.", "Rename all but one."),
    _r("QUALITY-005", "Power without hints", "quality", "info",
       "A client can't know when to ask.", "State what the tool may change."),
)
BY_ID = {r.rule_id: r for r in RULES}


def rule_rows(spark: SparkSession) -> DataFrame:
    """The catalog as a DataFrame (75 rows, fixed)."""
    return spark.createDataFrame([asdict(r) for r in RULES])
