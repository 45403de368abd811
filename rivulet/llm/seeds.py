"""Words of abuse and written examples of abusive and of harmless sentences, the start of training (fixed values).

The examples are invented; none shares a run of four words with a text that the operators are tested on.
"""

from __future__ import annotations

LEXICON = """
arse arsehole ass asshole bastard bellend bimbo bitch bollocks braindead bullshit clown cockroach coward cretin cum cunt
degenerate dick dickhead die dimwit disgusting dope douchebag dumb dumbass dumbest dumbo dunce fag faggot filth fool freak
fuck fucker fucking garbage halfwit hell horny hooker idiot imbecile inbred jackass jerk kill kys leech liar loser losers
lunatic maggot mongrel moron motherfucker naked nazi nitwit nude nudes numbskull oaf parasite pathetic pervert pig pinhead
piss porn prick pussy rat retard retarded rubbish savage savages scum scumbag sex sexy shit shithead slag slob slut sluts
stupid subhuman swine tits tosser tramp trash twat twit ugly vermin wanker waste weasel weirdo whore whores worm worthless
""".split()

#: {n} stands for an insult, {a} for what goes before one, {g} for a group of people; the other letters for insults in other languages.
_ABUSIVE = """
you {n}
you {a} {n}
ugh, another {a} {n}
get off this site {n}
go away {n}
nobody asked you {n}
shut it {n}
shut it you {a} {n}
I hope you choke on it {n}
how is a {n} like this still posting
listen here {n}
spoken like a true {n}
typical {n} answer
you are dumber than a brick
you absolute {n}
your whole family is {a}
your brain must be made of mud
even a goldfish is smarter than you
everything you say is {a} just like your face
the author of this is a {a} {n}
the mods here are all {n}
this guy is a {a} {n}
she is nothing but a {n}
he is a {n} and always will be
fuck yourself {n}
fuck you
eat shit {n}
rot in hell {n}
go hang yourself
please jump off a bridge
the planet improves the day you die
I am going to hurt you
I will smash your face in
I will come to your house tonight with a bat
you will not survive the week
wait until I get my hands on you
better look over your shoulder from now on
your kids are not safe from me
we should string them all up
{g} should be wiped out
{g} are animals
{g} are a disease
{g} are all criminals and parasites
deport all {g}
keep {g} out of our streets
gas the {g}
{g} do not belong among humans
I hate {g} and so should you
show me your tits
send pics of your naked ass
I want to fuck you so hard
suck my dick
she was riding him and moaning louder and louder
come sit on my face
looking for horny girls to sext with
he slid his hand into her wet panties
hardcore porn videos for free
du {d}
so ein {d} wie du
verpiss dich du {d}
ich bringe dich um
espèce de {f}
quel {f} ce type
je vais te tuer
eres un {s}
qué {s} eres
te voy a matar
sei proprio un {i}
ti ammazzo
seu {p}
vou te matar
jij {l}
ik maak je af
ты {r}
я тебя убью
"""

_FILL = {
    "a": "stupid pathetic worthless disgusting ugly dumb retarded",
    "n": "idiot moron loser asshole bastard bitch imbecile scumbag prick cunt",
    "g": "foreigners gays muslims jews blacks gypsies",
    "d": "Idiot Arschloch Wichser Trottel",
    "f": "connard abruti salope",
    "s": "idiota gilipollas cabrón",
    "i": "coglione stronzo idiota",
    "p": "otário idiota babaca",
    "l": "eikel klootzak idioot",
    "r": "идиот дебил урод",
}

_HARMLESS = """
my own stupid mistake cost me an hour
what an ugly cable but it does the job
I am such a loser at chess
we lost again because the goalkeeper slept
this printer is a piece of garbage
the delivery was a pathetic two weeks late
worst burger of my life, never again
that boss fight is a real bastard
fucking finally, it ships on Monday
shit, I left the oven on
shit happens
holy shit that was fast
holy crap, the goal in the last minute
this guitar sounds fucking amazing
the soup is fucking delicious
so fucking tired after work
a fucking great concert
a shitty commute in the rain
a recipe that is idiot-proof and quick
idiot-proof assembly, even I managed
dummy-proof instructions for beginners
damn this heat
hell yes, we won
it cost me a hell of a lot of time
she reported a man who had called her a whore
the article explains why words like retard hurt people
he was banned for calling others idiots
somebody called me a moron and I blocked them
they called her a slut, so she told the teacher
a stranger called us losers and the admin removed it
my boss called him an imbecile and apologised later
being called an idiot every day is bullying, so report it
slurs against jews or muslims get you banned here
the court jailed the man who had threatened to kill his neighbour
police arrested the attacker after the bomb threat
the novel opens with a murder
in the last chapter the villain threatens to burn the village
the song is called kill the lights
dying to see the new season
I nearly died laughing
you could kill two birds with one stone
my legs are killing me after that run
kill the process and start it again
the garbage truck comes on Thursdays
trash day is Friday
how do I get rid of rats in the cellar
the vermin in the grain store were dealt with
a parasite of bees has spread
the dog bit the postman
a female dog is called a bitch by breeders
the cock crows at dawn
Dick sent the minutes of the meeting
breast cancer runs in families
the doctor explained safe sex to the class
nude colours are in fashion this spring
the exhibition shows naked figures by Rodin
shoot the photo against the light
hit me up when you are in town
beat the eggs until stiff
execute the script as root
master and slave cylinders of the clutch
immigrants opened a bakery on our street
foreigners need a visa for this country
my muslim neighbours brought us sweets
the gay couple next door adopted a cat
you are right, thanks
you are all very kind
are you sure about that
see you tomorrow
does this work with the old charger
ich Idiot habe den Schlüssel vergessen
das Wetter ist heute scheiße
quel temps pourri
qué mierda de tiempo hace
che schifo di tempo
que tempo horrível
wat een rotweer
ужасная погода сегодня
yes
no
maybe
thanks
indeed
"""


def abusive() -> list[str]:
    """Every pattern with each of its fillers in turn."""
    out = []
    for line in _ABUSIVE.strip().splitlines():
        words = {k: v.split() for k, v in _FILL.items() if f"{{{k}}}" in line}
        for i in range(max([1, *map(len, words.values())])):
            out.append(line.format(**{k: w[(i + j) % len(w)] for j, (k, w) in enumerate(words.items())}))
    return out


def harmless() -> list[str]:
    return _HARMLESS.strip().splitlines()
